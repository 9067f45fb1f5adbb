"""Names of files in reports, resolved to files of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.scalars import norm_path, strip_scheme


def unique_suffixes(known: DataFrame) -> DataFrame:
    """suffix, file: trailing runs of whole segments that a single known file ends in."""
    parts = F.split("path", "/")
    every = known.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    return every.groupBy("suffix").agg(F.count("*").alias("n"), F.min("path").alias("file")).where("n = 1").select("suffix", "file")


def suffix_rescue(names: DataFrame, known: DataFrame) -> DataFrame:
    """names: name. name, file by the longest trailing run of segments that fits one known file; names without one are left out.

    A suffix with several files is dropped before the join, so a name as common as __init__.py adds no rows.
    """
    parts = F.filter(F.split("name", "/"), lambda s: (s != "") & (s != "."))
    tails = names.distinct().select("name", parts.alias("p")).where(F.size("p") > 0)
    tails = tails.select("name", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))).alias("i", "suffix"))
    return tails.join(unique_suffixes(known), "suffix").groupBy("name").agg(F.min_by("file", "i").alias("file"))


def resolve(places: DataFrame, known: DataFrame, root: str = "") -> DataFrame:
    """places: uri, base. uri, base, file, reason (ok, no-uri, unmatched, escapes-root) for each distinct pair.

    Absolute names lie under root or are rescued; relative ones are known or are rescued. A file outside of root is never named.
    """
    u = strip_scheme(F.col("uri"))
    rooted = F.startswith(u, F.lit("/"))
    joined = F.when((F.col("base") != "") & ~rooted, F.concat(F.regexp_replace("base", "/$", ""), F.lit("/"), u)).otherwise(u)
    p = places.select("uri", F.coalesce("base", F.lit("")).alias("base")).distinct().withColumn("name", F.when(F.coalesce("uri", F.lit("")) != "", norm_path(joined)))
    top = root.rstrip("/")
    absolute = F.startswith("name", F.lit("/")) | F.col("name").rlike("^[A-Za-z]:/")
    inside = F.when(absolute, F.when(F.startswith("name", F.lit(top + "/")), F.substring("name", len(top) + 2, 1 << 30)) if top else F.lit(None)).otherwise(F.col("name"))
    p = p.withColumn("inside", inside)
    files = known.select(F.col("path").alias("k")).distinct()
    p = p.join(files, p.inside == files.k, "left")
    # An absolute name under root counts even if the file is unknown.
    direct = F.when(absolute, F.col("inside")).otherwise(F.col("k"))
    p = p.withColumn("direct", F.when(~F.startswith("inside", F.lit("../")) & (F.col("inside") != ".."), direct)).drop("k", "inside")
    rescued = suffix_rescue(p.where("name is not null and direct is null").select("name"), known).withColumnRenamed("file", "rescued")
    p = p.join(rescued, "name", "left")
    file = F.coalesce("direct", "rescued")
    reason = F.when(F.col("name").isNull(), "no-uri").when(file.isNotNull(), "ok").when(F.startswith("name", F.lit("../")), "escapes-root").otherwise("unmatched")
    return p.select("uri", "base", file.alias("file"), reason.alias("reason"))
