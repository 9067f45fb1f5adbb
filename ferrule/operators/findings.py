"""Finding rows: built from raw results, merged, ordered and numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.scalars import confidence_of, cwe_layers, line_drift, parse_cwe_array, semgrep_severity, severity_of, sink_id
from ferrule.operators.ordering import positions
from ferrule.operators.paths import resolve

KEY = ("rule_id", "source_file", "source_line", "sink_file", "sink_line")
ORDER = ("sink_file", "sink_line", "source_file", "source_line", "rule_id")
HOP = "struct<file:string,line:int,expr:string>"


def resolved(raw: DataFrame, known: DataFrame, root: str = "") -> DataFrame:
    """raw with rid, sink_at (file, line, snippet, fqn, expr) and hops_at: places that could be resolved, in order."""
    r = raw.where("problem is null").withColumn("rid", F.struct("doc", "run", "ord"))
    sinks = r.select("rid", F.lit(-1).alias("i"), "sink.*")
    flows = r.select("rid", F.posexplode("flow").alias("i", "p")).select("rid", "i", "p.*")
    places = sinks.union(flows)
    files = resolve(places, known, root)
    at = places.join(files.withColumnRenamed("uri", "u").withColumnRenamed("base", "b"), F.col("uri").eqNullSafe(F.col("u")) & (F.col("base") == F.col("b")), "left")
    place = F.struct("i", "file", "line", "snippet", "fqn", "expr")
    # A result's own places: bounded by the result.
    both = at.groupBy("rid").agg(F.sort_array(F.collect_list(place)).alias("p"), F.max(F.when(F.col("i") == -1, F.col("reason"))).alias("reason"))
    j = r.join(both, "rid")
    sink = F.get(F.filter("p", lambda x: x["i"] == -1), F.lit(0))
    flow = F.filter("p", lambda x: (x["i"] >= 0) & x["file"].isNotNull())
    return j.withColumn("sink_at", sink).withColumn("flow_at", flow).drop("p")


def dropped(raw: DataFrame, at: DataFrame) -> DataFrame:
    """uri, reason, tool of results that are no findings."""
    bad = raw.where("problem is not null").select("uri", F.col("problem").alias("reason"), "tool")
    off = at.where("sink_at.file is null or (kind = 'semgrep' and sink_at is null)").select(F.col("sink.uri").alias("uri"), F.lit("sink-unbound").alias("reason"), "tool")
    return bad.union(off)


def normalized(at: DataFrame) -> DataFrame:
    """One row per result whose sink is known, with the columns of a finding that don't need the files."""
    a = at.where("sink_at.file is not null")
    sarif = F.col("kind") == "sarif"
    # Semgrep's flow counts only if its source was resolved.
    source_ok = F.exists("flow_at", lambda x: x["i"] == 0)
    has_flow = F.when(sarif, F.size("flow_at") > 0).otherwise(source_ok)
    flow = F.when(has_flow, F.col("flow_at")).otherwise(F.array().cast(a.schema["flow_at"].dataType))
    last = F.try_element_at(flow, F.lit(-1))
    ends = F.coalesce((last["file"] == F.col("sink_at.file")) & (last["line"] == F.col("sink_at.line")), F.lit(False)) & sarif
    hops = F.when(has_flow & ends, flow).otherwise(F.concat(flow, F.array("sink_at")))
    a = a.withColumn("has", has_flow).withColumn("h", hops)
    trace = F.array_distinct(F.transform("h", lambda x: F.when(sarif & (F.coalesce(x["fqn"], F.lit("")) != ""), x["fqn"]).otherwise(F.concat(x["file"], F.lit(":"), x["line"].cast("string")))))
    own = F.when(sarif, sink_id(F.col("rule_id"))).otherwise(F.element_at(F.split("rule_id", r"\.", -1), -1))
    tool = F.lower(F.split("tool", " ", 2)[0])
    source = F.get("h", F.lit(0))
    alt = F.when(F.col("alt_flows") > 0, F.array(F.concat(F.lit("ingest:+"), F.col("alt_flows").cast("string"), F.lit("-alt-flows")))).otherwise(F.array().cast("array<string>"))
    return a.select(
        "rid", "path", "tool", F.col("rule_id").alias("raw_rule"), F.when(F.coalesce("rule_id", F.lit("")) == "", own).otherwise(F.col("rule_id")).alias("rule_id"), own.alias("sink_id"),
        F.when(F.col("has"), F.concat(F.when(sarif, tool).otherwise("semgrep"), F.lit(":source"))).otherwise(own).alias("source_id"),
        source["file"].alias("source_file"), source["line"].alias("source_line"), F.col("sink_at.file").alias("sink_file"), F.col("sink_at.line").alias("sink_line"), F.col("sink_at.snippet").alias("snippet"),
        F.transform("h", lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), F.coalesce(x["expr"], F.lit("")).alias("expr"))).alias("hops"), trace.alias("trace"),
        parse_cwe_array(F.col("cwe_sources")).alias("cwe"), F.when(sarif, severity_of(F.col("level"), F.col("security_severity"))).otherwise(semgrep_severity(F.col("severity"))).alias("severity"),
        confidence_of(F.col("precision"), F.col("confidence")).alias("confidence"), F.left("message", F.lit(500)).alias("message"),
        F.coalesce(F.when(sarif, source["fqn"]), F.lit("")).alias("function"), F.coalesce(F.when(sarif, F.col("sink_at.fqn")), F.lit("")).alias("sink_function"),
        F.concat(F.array(F.concat(F.lit("ingest:"), "kind"), F.concat(F.lit("tool:"), "tool")), alt).alias("provenance"),
    )


def at_lines(points: DataFrame, lines: DataFrame) -> DataFrame:
    """points with file and line; text: the line without blanks at its ends, or empty."""
    text = lines.select("file", F.col("n").alias("line"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
    return points.join(text, ["file", "line"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def slices(findings: DataFrame, lines: DataFrame, key: str = "rid") -> DataFrame:
    """findings with source_slice and sink_slice."""
    wanted = findings.select(F.explode(F.array(F.struct(F.col("source_file").alias("file"), F.col("source_line").alias("line")), F.struct(F.col("sink_file").alias("file"), F.col("sink_line").alias("line")))).alias("p")).select("p.*").distinct()
    text = at_lines(wanted, lines)
    one = text.select(F.col("file").alias("source_file"), F.col("line").alias("source_line"), F.col("text").alias("source_slice"))
    two = text.select(F.col("file").alias("sink_file"), F.col("line").alias("sink_line"), F.col("text").alias("sink_slice"))
    return findings.join(one, ["source_file", "source_line"], "left").join(two, ["sink_file", "sink_line"], "left")


def hashes_of(findings: DataFrame, hashes: DataFrame, key: str) -> DataFrame:
    """key, file_hashes: a map over the files of each finding; empty for a file that is not there."""
    hops = F.transform("hops", lambda h: h["file"]) if "hops" in findings.columns else F.array().cast("array<string>")
    files = findings.select(key, F.explode(F.array_distinct(F.concat(F.array("source_file", "sink_file"), hops))).alias("file"))
    j = files.join(hashes, "file", "left").select(key, "file", F.coalesce("hash", F.lit("")).alias("hash"))
    return j.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "hash")))).alias("file_hashes"))


def built(rows: DataFrame, lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows with layers, slices, hashes and the guards' first state; a line that no longer says what the tool saw lowers the confidence."""
    s = slices(rows, lines)
    drift = line_drift(F.coalesce("snippet", F.lit("")), F.col("sink_slice"))
    base = F.array_sort(F.array_distinct(F.concat(F.array(F.lit("dangerous-sink"), F.lit("untrusted-input")), cwe_layers(F.col("cwe")))))
    s = s.withColumn("provenance", F.when(drift, F.array_append("provenance", F.lit("ingest:line-drift"))).otherwise(F.col("provenance"))).withColumn("confidence", F.when(drift, "low").otherwise(F.col("confidence")))
    s = s.withColumn("layers", base).withColumn("guards", F.array().cast("array<string>")).withColumn("unguarded", F.lit(False)).withColumn("guard_status", F.lit("unknown"))
    return s.join(hashes_of(s, hashes, "rid"), "rid", "left").drop("snippet", "raw_rule")


def dedup_first(rows: DataFrame, key=KEY, order: str = "rid", provenance: str = "provenance") -> DataFrame:
    """The first row of each key; later rows only add tools to its provenance, in their order."""
    others = [c for c in rows.columns if c not in key]
    tools = F.sort_array(F.collect_set(F.struct(order, F.filter(provenance, lambda p: F.startswith(p, F.lit("tool:"))).alias("t"))))
    g = rows.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("first"), tools.alias("tools"))
    g = g.select(*key, "first.*", "tools")
    return g.withColumn(provenance, F.array_distinct(F.concat(provenance, F.flatten(F.transform("tools", lambda x: x["t"]))))).drop("tools")


def merge_guards(rows: DataFrame, key, order: Column) -> DataFrame:
    """Rows of one key become the first of them, guarded by what guards all of them. rows: guards array."""
    others = [c for c in rows.columns if c not in (*key, "guards")]
    n = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min_by(F.struct(*others), order).alias("first"))
    # A guard that every row of the key has: counted, not collected.
    each = rows.select(*key, F.explode(F.array_distinct("guards")).alias("g")).groupBy(*key, "g").agg(F.count("*").alias("m"))
    same = each.join(n.select(*key, "n"), list(key)).where("m = n").groupBy(*key).agg(F.array_sort(F.collect_set("g")).alias("guards"))
    return n.select(*key, "first.*").join(same, list(key), "left").withColumn("guards", F.coalesce("guards", F.array().cast("array<string>")))


def numbered(findings: DataFrame, order=ORDER) -> DataFrame:
    """findings with id path-0000 and on, in one global order."""
    i = F.col("_number").cast("string")
    wide = F.when(F.char_length(i) < 4, F.lpad(i, 4, "0")).otherwise(i)
    return positions(findings, order, "_number", 0).withColumn("id", F.concat(F.lit("path-"), wide)).drop("_number")
