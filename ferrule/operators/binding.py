"""Points bound to code: the tightest span around a line, the nearest definition before it, or the file.

Range conditions are turned into equalities of grid cells or of stretches of lines, so that a file with very many rows is spread over tasks;
what wins is chosen by an aggregate, which is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _level(start: Column, end: Column) -> Column:
    """The least n with end - start < 2^n."""
    return F.when(end <= start, 0).otherwise(F.char_length(F.bin((end - start).cast("long")))).cast("int")


def tightest_span(points: DataFrame, spans: DataFrame, key: str = "file") -> DataFrame:
    """points: id, file, line. spans: file, start, end, node. id, node: of the spans around the line the one that starts last; ties to the smallest node. Lines are whole numbers.

    An interval join on equalities, without pairs: a span is filled with the largest cells of powers of two that lie in it (two of a size at most), and a cell keeps the best
    span that holds it whole, which is the best for all its lines. So a point meets one row of each size at most (64), however many spans lie around it, and equal
    places count once.
    """
    s = spans.where("start <= end").groupBy(key, "start", "end").agg(F.min("node").alias("node"))
    s = s.withColumn("level", _level(F.col("start"), F.col("end")))
    top = s.agg(F.max("level")).first()[0]  # 63 at most
    if top is None:
        return points.select("id", F.lit(None).cast(spans.schema["node"].dataType).alias("node")).where("false")
    # At each size the cells from the first that starts in the span to the last that ends in it; those that no larger cell will hold are odd ones at its ends.
    a, z = "-shiftright(-CAST(start AS BIGINT), i)", "shiftright(CAST(end AS BIGINT) + 1, i)"
    ends = f"array(struct({a} AS cell, {a} < {z} AND {a} & 1 = 1 AS own), struct({z} - 1 AS cell, {a} < {z} AND {z} & 1 = 1 AS own))"
    cells = F.expr(f"flatten(transform(sequence(0, level), i -> transform(filter({ends}, c -> c.own), c -> struct(i AS level, c.cell AS cell))))")
    order = F.struct((-F.col("start")).alias("o"), F.col("node"))
    best = s.select(key, order.alias("best"), F.explode(cells).alias("c")).groupBy(key, F.col("c.level").alias("level"), F.col("c.cell").alias("cell")).agg(F.min("best").alias("best"))
    places = points.select(key, "line").dropna().distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    places = places.withColumn("cell", F.expr("shiftright(CAST(line AS BIGINT), level)"))
    found = places.join(best, [key, "level", "cell"]).groupBy(key, "line").agg(F.min("best").alias("best"))
    return points.select("id", key, "line").join(found, [key, "line"]).groupBy("id").agg(F.min("best").alias("best")).select("id", "best.node")


def nearest_preceding(points: DataFrame, definitions: DataFrame, key: str = "file", width: int = 1 << 14) -> DataFrame:
    """points: id, file, line. definitions: file, def_line, node. id, node: the last definition at or before the line.

    An as-of join by sorting stretches of `width` lines: within a stretch the last definition is carried forward, and what a stretch starts
    with comes from a summary of one row per stretch. So a key with very many rows is not one task's.
    """
    d = definitions.groupBy(key, "def_line").agg(F.min("node").alias("node"))
    node, ids = d.schema["node"].dataType, points.schema["id"].dataType
    stretch = lambda c: F.floor(F.col(c) / width).alias("stretch")
    both = points.select(key, stretch("line"), F.col("line").alias("at"), F.lit(1).alias("asks"), "id", F.lit(None).cast(node).alias("node"))
    both = both.unionByName(d.select(key, stretch("def_line"), F.col("def_line").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast(ids).alias("id"), "node"))
    ends = d.select(key, stretch("def_line"), "def_line", "node").groupBy(key, "stretch").agg(F.max_by("node", "def_line").alias("last"))
    asked = both.select(key, "stretch").distinct().join(ends, [key, "stretch"], "left")
    before = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.select(key, "stretch", F.last("last", ignorenulls=True).over(before).alias("carried"))
    w = Window.partitionBy(key, "stretch").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("node", F.last("node", ignorenulls=True).over(w)).where("asks = 1")
    return own.join(carried, [key, "stretch"], "left").select("id", F.coalesce("node", "carried").alias("node")).where("node is not null")


def bind(points: DataFrame, spans: DataFrame, definitions: DataFrame, files: DataFrame) -> DataFrame:
    """points: id, file, line. id, node, method: by span, else nearest-def, else file, else none."""
    s = tightest_span(points, spans).withColumnRenamed("node", "by_span")
    d = nearest_preceding(points, definitions).withColumnRenamed("node", "by_def")
    f = files.groupBy("file").agg(F.min("node").alias("by_file"))
    j = points.select("id", "file").join(s, "id", "left").join(d, "id", "left").join(f, "file", "left")
    method = F.when(F.col("by_span").isNotNull(), "span").when(F.col("by_def").isNotNull(), "nearest-def").when(F.col("by_file").isNotNull(), "file").otherwise("none")
    return j.select("id", F.coalesce("by_span", "by_def", "by_file").alias("node"), method.alias("method"))


def join_functions(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """functions: fn, file, line, end_line. nodes of an entity graph: id, label, file_type, source_file, source_location. fn, node by file and line."""
    n = code_nodes(nodes).groupBy("file", "def_line").agg(F.min_by("node", "ord").alias("node"))
    f = functions.select("fn", "file", "line", "end_line")
    return f.join(n, (f.file == n["file"]) & (f.line == n.def_line), "left").select("fn", f.file, "line", "end_line", "node")


def code_nodes(nodes: DataFrame) -> DataFrame:
    """file, def_line, node, ord of function nodes."""
    line = F.regexp_extract("source_location", r"^L(\d+)$", 1)
    some = nodes.where((F.col("file_type") == "code") & F.col("label").endswith("()") & (line != "") & F.col("source_file").isNotNull())
    return some.select(F.col("source_file").alias("file"), line.cast("int").alias("def_line"), F.col("id").alias("node"), "ord" if "ord" in nodes.columns else F.col("id").alias("ord"))


def file_nodes(nodes: DataFrame) -> DataFrame:
    """file, node of nodes that stand for a whole file."""
    own = F.element_at(F.split("source_file", "/"), -1) == F.col("label")
    return nodes.where((F.col("file_type") == "code") & own).select(F.col("source_file").alias("file"), F.col("id").alias("node"))


def bind_findings(findings: DataFrame, functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """findings with source_node, sink_node and a binding:<method> of the sink in provenance."""
    spans = join_functions(functions, nodes).where("node is not null").select("file", F.col("line").alias("start"), F.col("end_line").alias("end"), "node")
    defs, files = code_nodes(nodes), file_nodes(nodes)
    ends = findings.select("id", F.explode(F.array(F.struct(F.lit("source").alias("role"), F.col("source_file").alias("file"), F.col("source_line").alias("line")), F.struct(F.lit("sink").alias("role"), F.col("sink_file").alias("file"), F.col("sink_line").alias("line")))).alias("p"))
    points = ends.select(F.struct("id", "p.role").alias("id"), "p.file", "p.line")
    b = bind(points, spans, defs, files).select("id.id", "id.role", "node", "method")
    wide = b.groupBy("id").agg(F.max(F.when(F.col("role") == "source", F.col("node"))).alias("source_node"), F.max(F.when(F.col("role") == "sink", F.col("node"))).alias("sink_node"), F.max(F.when(F.col("role") == "sink", F.col("method"))).alias("m"))
    own = [c for c in findings.columns if c not in ("source_node", "sink_node")]
    j = findings.select(*own).join(wide, "id", "left")
    return j.withColumn("provenance", F.array_append("provenance", F.concat(F.lit("binding:"), "m"))).drop("m")


def binding_counts(bound: DataFrame) -> DataFrame:
    """method, n over the sinks."""
    return bound.select(F.explode("provenance").alias("p")).where("p like 'binding:%'").groupBy(F.substring("p", 9, 100).alias("method")).agg(F.count("*").alias("n"))


def annotate(nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """nodes with sec_layers, the sorted union of the layers of findings that end there; no node is added or lost."""
    ends = bound.select("layers", F.explode(F.array("source_node", "sink_node")).alias("id")).select("id", F.explode("layers").alias("layer"))
    layers = ends.where("id is not null").groupBy("id").agg(F.array_sort(F.collect_set("layer")).alias("sec_layers"))
    return nodes.join(layers, "id", "left").withColumn("sec_layers", F.coalesce("sec_layers", F.array().cast("array<string>")))


def hyperedges(bound: DataFrame) -> DataFrame:
    """id, kind, label, nodes: an edge per finding whose ends are two nodes."""
    b = bound.where("source_node is not null and sink_node is not null and source_node <> sink_node")
    label = F.concat(F.col("source_id"), F.lit(" -> "), F.col("sink_id"), F.when(F.coalesce("cwe", F.lit("")) != "", F.concat(F.lit(" ("), "cwe", F.lit(")"))).otherwise(""))
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("int").cast("string")
    return b.select(F.concat(F.lit("sec-path-"), number).alias("id"), F.lit("taint-path").alias("kind"), label.alias("label"), F.array_sort(F.array("source_node", "sink_node")).alias("nodes"))
