"""What the code around a finding adds: layers by names and literals on its lines, and the guards at its sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.labels import ident_layers, identifiers, literals, secret
from ferrule.operators.binding import tightest_span
from ferrule.operators.findings import at_lines
from ferrule.operators.lowering import facts
from ferrule.sources.rules import Rules


def flow_points(findings: DataFrame, key: str) -> DataFrame:
    """key, role, file, line of source, sink and hops."""
    ends = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_file").alias("file"), F.col(f"{r}_line").alias("line")) for r in ("source", "sink")])
    hops = F.transform("hops", lambda h: F.struct(F.lit("hop").alias("role"), h["file"].alias("file"), h["line"].alias("line")))
    return findings.select(key, F.explode(F.concat(ends, hops)).alias("p")).select(key, "p.*")


def label_layers(findings: DataFrame, lines: DataFrame, rules: Rules, key: str = "id") -> DataFrame:
    """findings with layers added (never removed) by what stands on their lines, and where each came from in provenance."""
    text = at_lines(flow_points(findings, key), lines).where("text <> ''")
    named = text.select(key, "role", F.explode(identifiers(F.col("text"))).alias("x")).select(key, ident_layers(F.col("x"), rules).alias("layers"), F.concat(F.lit("enrich:lexical@"), "role").alias("by"))
    formed = text.select(key, F.explode(literals(F.col("text"))).alias("x")).select(key, secret(F.col("x"), rules).alias("s")).where("s is not null").select(key, F.col("s.layers").alias("layers"), F.concat(F.lit("enrich:"), "s.source_id").alias("by"))
    hits = named.where(F.size("layers") > 0).union(formed)
    added = hits.select(key, F.explode("layers").alias("layer"), "by").groupBy(key).agg(F.collect_set("layer").alias("more"), F.array_sort(F.collect_set("by")).alias("by"))
    none = F.array().cast("array<string>")
    j = findings.join(added, key, "left").withColumn("layers", F.array_sort(F.array_union("layers", F.coalesce("more", none)))).withColumn("provenance", F.concat("provenance", F.coalesce("by", none)))
    return j.drop("more", "by")


def guard_verdicts(findings: DataFrame, lowered: DataFrame, rules: Rules, key: str = "id") -> DataFrame:
    """findings with guards, unguarded and guard_status=analyzed where the sink lies in a function that could be read; the others stay unknown."""
    f = facts(lowered, "function").select("fn", F.col("file").alias("sink_file"), F.col("line").alias("start"), F.col("end_line").alias("end"), "decorators", "guards")
    s = findings.select(key, "sink_file", "sink_line").where(F.col("sink_file").endswith(".py"))
    points = s.select(F.col(key).alias("id"), F.col("sink_file").alias("file"), F.col("sink_line").alias("line"))
    inside = tightest_span(points, f.select(F.col("sink_file").alias("file"), "start", "end", F.col("fn").alias("node")))
    best = inside.select(F.col("id").alias(key), F.col("node").alias("fn")).join(s.select(key, "sink_line"), key).join(f.select("fn", "decorators", "guards"), "fn")
    st = facts(lowered, "stmt").select("fn", "sid", "start_line", "end_line")
    around = best.select(key, "fn", "sink_line").join(st, "fn").where("start_line <= sink_line and sink_line <= end_line")
    # The innermost statement; of several on one line the deepest, which has the largest number.
    sid = around.groupBy(key).agg(F.max_by("sid", F.struct("start_line", -F.col("end_line"), "sid")).alias("sid"))
    b = best.join(sid, key, "left")
    barred = F.filter("decorators", lambda d: d.isin(*rules.barriers["decorators"]) if rules.barriers["decorators"] else F.lit(False))
    verdict = b.select(key, F.coalesce(F.element_at("guards", F.col("sid").cast("string")), barred).alias("g"))
    j = findings.join(verdict, key, "left")
    known = F.col("g").isNotNull()
    j = j.withColumn("guards", F.when(known, F.col("g")).otherwise(F.col("guards"))).withColumn("unguarded", F.when(known, F.size("g") == 0).otherwise(F.col("unguarded"))).withColumn("guard_status", F.when(known, "analyzed").otherwise(F.col("guard_status")))
    return j.drop("g")
