"""Questions about findings: filter, rank, page, slice, explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.scalars import CONFIDENCES, confidence_rank, ranked, severity_rank
from ferrule.sources.rules import Rules


def status() -> Column:
    return F.coalesce("guard_status", F.lit("analyzed"))


def guard_rank() -> Column:
    """Unguarded first, then unknown, then guarded."""
    return F.when(F.coalesce("unguarded", F.lit(False)), 0).when(status() == "unknown", 1).otherwise(2)


def rank_order() -> list[Column]:
    return [guard_rank().asc(), severity_rank(F.col("severity")).desc(), confidence_rank(F.col("confidence")).desc(), F.col("id").asc()]


def summary(findings: DataFrame) -> DataFrame:
    at = lambda end: F.concat(F.col(f"{end}_id"), F.lit(" @ "), F.col(f"{end}_file"), F.lit(":"), F.col(f"{end}_line").cast("string")).alias(end)
    return findings.select("id", "cwe", "severity", at("source"), at("sink"), "layers", "confidence", "unguarded", status().alias("guard_status"), "guards", F.col("trace").alias("hops"))


def with_status(findings: DataFrame) -> DataFrame:
    return findings if "guard_status" in findings.columns else findings.withColumn("guard_status", F.lit("analyzed"))


def filtered(findings: DataFrame, layer: str | None = None, min_confidence: str | None = None, file: str | None = None) -> DataFrame:
    f = findings
    if layer:
        f = f.where(F.array_contains("layers", layer))
    if file:
        f = f.where((F.col("source_file") == file) | (F.col("sink_file") == file))
    if min_confidence:
        f = f.where(confidence_rank(F.col("confidence")) >= ranked(CONFIDENCES).get(min_confidence, 0))
    return f


def list_paths(findings: DataFrame, layer=None, min_confidence=None, file=None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of summaries, worst first, and one row with the total."""
    f = filtered(with_status(findings), layer, min_confidence, file)
    page = f.orderBy(*rank_order()).offset(offset).limit(max(0, limit))
    return summary(page), f.agg(F.count("*").alias("total"))


def find_unguarded_sinks(findings: DataFrame, layer=None, include_unknown: bool = False) -> tuple[DataFrame, DataFrame]:
    """Summaries of unguarded findings (and of unknown ones if asked), worst first, and one row with the number of unknown ones."""
    f = with_status(findings)
    want = F.coalesce("unguarded", F.lit(False)) | ((F.col("guard_status") == "unknown") if include_unknown else F.lit(False))
    rows = filtered(f.where(want), layer)
    return summary(rows.orderBy(*rank_order())), f.agg(F.count_if(F.col("guard_status") == "unknown").alias("unknown_count"))


def windows(points: DataFrame, lines: DataFrame, around: int = 3) -> DataFrame:
    """points: file, line and others. A row per line of each window: n, text, mark."""
    near = points.withColumn("n", F.explode(F.sequence(F.greatest(F.col("line") - around, F.lit(1)), F.greatest(F.col("line") + around, F.lit(1)))))
    return near.join(lines, ["file", "n"]).withColumn("mark", F.col("n") == F.col("line"))


def get_path_slice(findings: DataFrame, path_id: str, lines: DataFrame, hashes: DataFrame, around: int = 3) -> DataFrame:
    """Rows ord, role, file, line, stale, n, text, mark of a path's windows: each place once, stale if its file is no longer what was analyzed."""
    f = findings.where(F.col("id") == path_id)
    place = lambda role, file, line: F.struct(F.lit(role).alias("role"), file.alias("file"), line.alias("line"))
    ends = F.array(place("source", F.col("source_file"), F.col("source_line")), place("sink", F.col("sink_file"), F.col("sink_line")))
    if "hops" in findings.columns:
        role = lambda i: F.when(i == 0, "source").when(i == F.size("hops") - 1, "sink").otherwise("hop")
        steps = F.when(F.size("hops") > 0, F.transform("hops", lambda h, i: F.struct(role(i).alias("role"), h["file"].alias("file"), h["line"].alias("line")))).otherwise(ends)
    else:
        steps = ends
    p = f.select("file_hashes", F.posexplode(steps).alias("ord", "p")).select("file_hashes", "ord", "p.*")
    if "hops" in findings.columns:
        p = p.groupBy("file", "line").agg(F.min_by(F.struct("ord", "role", "file_hashes"), "ord").alias("x")).select("file", "line", "x.*")
    now = p.join(hashes, "file", "left")
    expected = F.coalesce(F.element_at("file_hashes", F.col("file")), F.lit(""))
    now = now.withColumn("stale", F.when(F.col("hash").isNull(), True).otherwise((expected != "") & (expected != F.col("hash"))))
    return windows(now, lines, around).select("ord", "role", "file", "line", "stale", "n", "text", "mark").orderBy("ord", "n")


def explain_layer(spark: SparkSession, layer: str, rules: Rules, nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: layer, provenance (kind -> names), tagged_nodes, path_count; provenance is null for an unknown layer."""
    if layer == "untrusted-input":
        by = {"sources": [r["id"] for r in rules.sources if layer in r["layers"]]}
    elif layer == "dangerous-sink":
        by = {"sinks": [f"{r['id']} {r['cwe']}" if r["cwe"] else r["id"] for r in rules.sinks if layer in r["layers"]]}
    elif layer in rules.labels:
        by = {"identifiers": rules.labels[layer]["identifiers"], "confidence": [rules.labels[layer]["confidence"]], "secret_patterns": [p["id"] for p in (rules.secrets or {"patterns": []})["patterns"] if layer in p["layers"]]}
    elif layer == "auth":
        by = dict(rules.barriers)
    else:
        by = None
    own = spark.createDataFrame([(layer, by)], "layer string, provenance map<string,array<string>>")
    tagged = nodes.where(F.array_contains("sec_layers", layer)).agg(F.array_sort(F.collect_list("id")).alias("tagged_nodes"))
    count = findings.agg(F.count_if(F.array_contains("layers", layer)).alias("path_count"))
    return own.crossJoin(tagged).crossJoin(count)  # three single rows


def get_function_taint(findings: DataFrame, node_id: str) -> DataFrame:
    """Summaries of the paths that start or end at a node, worst first."""
    f = with_status(findings)
    return summary(f.where((F.col("source_node") == node_id) | (F.col("sink_node") == node_id)).orderBy(*rank_order()))


# What the map shows.


def is_critical() -> Column:
    return F.coalesce("unguarded", F.lit(False)) & F.arrays_overlap("layers", F.array(F.lit("credentials"), F.lit("pii")))


def visible(findings: DataFrame, active, unguarded_only: bool = False, critical_only: bool = False) -> DataFrame:
    """Findings that a map with these filters shows; active: data layers that are switched on."""
    if critical_only:
        return findings.where(is_critical())
    f = findings.where(F.coalesce("unguarded", F.lit(False))) if unguarded_only else findings
    return f.where(F.arrays_overlap("layers", F.array(*[F.lit(x) for x in active])))


def drawn_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between two known nodes, without loops."""
    known = nodes.select("id").distinct()
    return links.where("source <> target").join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")


def degrees(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def roll_up(findings: DataFrame) -> DataFrame:
    """id, layer (the strongest of credentials, pii, untrusted-input), unguarded, guarded of each node that a finding ends at; unknown says nothing."""
    f = with_status(findings).select("layers", "unguarded", "guard_status", F.explode(F.array("source_node", "sink_node")).alias("id")).where("id is not null")
    strongest = F.when(F.array_contains("layers", "credentials"), 0).when(F.array_contains("layers", "pii"), 1).when(F.array_contains("layers", "untrusted-input"), 2)
    g = f.groupBy("id").agg(F.min(strongest).alias("s"), F.bool_or((F.col("guard_status") == "analyzed") & F.col("unguarded")).alias("unguarded"), F.bool_or((F.col("guard_status") == "analyzed") & ~F.col("unguarded")).alias("guarded"))
    return g.select("id", F.get(F.array(F.lit("credentials"), F.lit("pii"), F.lit("untrusted-input")), F.col("s")).alias("layer"), "unguarded", "guarded")


def neighborhood(links: DataFrame, ends: DataFrame) -> DataFrame:
    """ends: id. The ends, the files that contain them and what they call or are called by."""
    e = ends.select("id").distinct()
    holds = links.where("relation = 'contains'").join(e.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    calls = links.where("relation = 'calls'")
    out = calls.join(e.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    into = calls.join(e.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    return e.union(holds).union(out).union(into).distinct()


def layer_counts(findings: DataFrame) -> DataFrame:
    return findings.select(F.explode(F.array_distinct("layers")).alias("layer")).groupBy("layer").agg(F.count("*").alias("n"))
