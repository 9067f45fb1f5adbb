"""From a source tree, or from reports about it, to findings, an annotated graph and files."""

from __future__ import annotations

import html
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.binding import annotate, bind_findings, binding_counts, hyperedges
from ferrule.operators.callgraph import binding_rate, category_counts, taint_relevant_resolution
from ferrule.operators.enrichment import guard_verdicts, label_layers
from ferrule.operators.findings import built, dedup_first, dropped, hashes_of, normalized, numbered, resolved, slices
from ferrule.operators.lowering import facts, lower_files
from ferrule.plans.graph import entity_graph
from ferrule.plans.state import kept
from ferrule.plans.taint import Analysis
from ferrule.sources.files import file_hashes, known_files, read_tree, source_files, source_lines
from ferrule.sources.reports import read_reports
from ferrule.sources.rules import Rules, default_rules


@dataclass
class Result:
    """What an analysis leaves: tables, all written out."""

    findings: DataFrame
    nodes: DataFrame
    links: DataFrame
    hyperedges: DataFrame
    lines: DataFrame
    hashes: DataFrame
    lowered: DataFrame
    dropped: DataFrame | None = None
    inputs: DataFrame | None = None
    analysis: Analysis | None = None

    def counts(self) -> dict:
        r = self.findings.agg(F.count("*").alias("findings"), F.count_if(F.coalesce("unguarded", F.lit(False))).alias("unguarded")).first()
        return {"findings": r.findings, "unguarded": r.unguarded, "binding": {x.method: x.n for x in binding_counts(self.findings).collect()}}


class Tree:
    """A source tree and what is read from it once."""

    def __init__(self, tree: DataFrame, rules: Rules):
        self.tree, self.rules = tree, rules
        self.known = known_files(tree)
        self.lines = source_lines(tree)
        self.hashes = file_hashes(tree)
        self.lowered = kept(lower_files(source_files(tree), rules), "lowered")


def _finish(t: Tree, findings: DataFrame, functions: DataFrame, bound: DataFrame, **more) -> Result:
    nodes, links = entity_graph(t.lowered, functions, bound)
    nodes = kept(nodes, "entities")
    findings = kept(bind_findings(findings, functions, nodes), "bound-findings")
    return Result(findings, kept(annotate(nodes, findings), "nodes"), kept(links, "links"), kept(hyperedges(findings), "hyperedges"), t.lines, t.hashes, t.lowered, **more)


def analyze_files(tree: DataFrame, rules: Rules | None = None, oracle: DataFrame | None = None) -> Result:
    """tree: path, content. The built-in analysis."""
    rules = rules or default_rules()
    t = Tree(tree, rules)
    a = Analysis(t.lowered, rules, oracle=oracle)
    order = ("source_file", "function", "source_id", "source_line", "sink_id", "sink_line", "sink_file")
    f = numbered(slices(a.findings, t.lines), order)
    f = f.join(hashes_of(f, t.hashes, "id"), "id", "left").withColumn("provenance", F.array().cast("array<string>"))
    return _finish(t, f, a.functions, a.bound, analysis=a)


def analyze_project(spark: SparkSession, root: str, rules: Rules | None = None) -> Result:
    return analyze_files(read_tree(spark, root), rules)


def ingest(reports: DataFrame, tree: DataFrame, rules: Rules | None = None, root: str = "") -> Result:
    """reports: doc, path, kind, content. Findings of other tools, resolved, merged, enriched and bound; the built-in analysis doesn't run."""
    rules = rules or default_rules()
    t = Tree(tree, rules)
    raw = kept(read_reports(reports), "raw")
    at = kept(resolved(raw, t.known, root), "resolved")
    rows = kept(normalized(at), "normalized")
    per_doc = rows.groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("tool")).alias("tools"))
    docs = reports.select("doc", "path", "kind", F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256)).alias("sha256"))
    inputs = docs.join(per_doc, "path", "left").select("doc", "path", "kind", "sha256", F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), F.coalesce("n", F.lit(0)).alias("n"))
    f = numbered(dedup_first(built(rows, t.lines, t.hashes))).drop("rid", "path", "tool")
    f = guard_verdicts(label_layers(f, t.lines, rules), t.lowered, rules)
    none = spark_empty_bound(f.sparkSession)
    return _finish(t, f, kept(facts(t.lowered, "function").drop("graph"), "functions"), none, dropped=dropped(raw, at), inputs=inputs)


def spark_empty_bound(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "fn string, target string, provenance string, kind string")


def analyze_ingest(spark: SparkSession, root: str, sarif=(), semgrep=(), rules: Rules | None = None) -> Result:
    paths = [(p, "sarif") for p in sarif] + [(p, "semgrep") for p in semgrep]
    docs = None
    for i, (p, kind) in enumerate(paths):
        d = spark.read.text(p, wholetext=True).select(F.lit(i).cast("long").alias("doc"), F.lit(p).alias("path"), F.lit(kind).alias("kind"), F.col("value").alias("content"))
        docs = d if docs is None else docs.union(d)
    if docs is None:
        raise ValueError("no reports")
    return ingest(docs, read_tree(spark, root), rules, root.removeprefix("file://"))


def call_statistics(result: Result) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rates of bound and unknown calls, counts by category, and the resolution of calls on tainted paths."""
    a = result.analysis
    return binding_rate(a.classified), category_counts(a.classified), taint_relevant_resolution(a.classified, a.tainted)


# Files.


def export(result: Result, out: str, root: str = ".", engine: dict | None = None) -> None:
    """Tables as Parquet under out; findings.json, graph.json and map.html beside them. JSON and HTML are views for people: what they hold is collected."""
    from pathlib import Path

    for name in ("findings", "nodes", "links", "hyperedges"):
        getattr(result, name).write.mode("overwrite").parquet(f"{out}/{name}")
    rows = [json.loads(x) for x in result.findings.orderBy("id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]
    graph = {n: [json.loads(x) for x in getattr(result, n).orderBy(*(("id",) if n != "links" else ("source", "target", "relation"))).select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0]] for n in ("nodes", "links", "hyperedges")}
    folder = Path(out)
    (folder / "findings.json").write_text(json.dumps({"version": 1, "root": root, "engine": engine or {"mode": "builtin"}, "findings": rows}, indent=2, ensure_ascii=False), encoding="utf-8")
    (folder / "graph.json").write_text(json.dumps(graph, indent=2, ensure_ascii=False), encoding="utf-8")
    (folder / "map.html").write_text(render_html(graph, rows, root), encoding="utf-8")


def embed(data) -> str:
    """JSON that can stand in a script element."""
    return json.dumps(data, ensure_ascii=False).replace("<", "\\u003c")


def render_html(graph: dict, findings: list[dict], root: str) -> str:
    """One self-contained page: a table of findings and the data for a map."""
    esc = lambda x: html.escape("" if x is None else str(x), quote=True)
    keep = ("id", "label", "source_file", "source_location", "file_type", "sec_layers", "community")
    small = {"nodes": [{k: n[k] for k in keep if k in n} for n in graph["nodes"]], "links": [{k: x[k] for k in ("source", "target", "relation")} for x in graph["links"]]}
    state = lambda f: "unguarded" if f.get("unguarded") else "unknown" if f.get("guard_status") == "unknown" else "guarded"
    rows = "".join(
        f"<tr class={state(f)}><td>{esc(f.get('id'))}<td>{esc(f.get('severity'))}<td>{state(f)}<td>{esc(f.get('source_id'))} @ {esc(f.get('source_file'))}:{esc(f.get('source_line'))}<td>{esc(f.get('sink_id'))} @ {esc(f.get('sink_file'))}:{esc(f.get('sink_line'))}<td>{esc(', '.join(f.get('layers') or []))}"
        for f in findings
    )
    return (
        f"<!doctype html><meta charset=utf-8><title>Findings of {esc(root)}</title><style>body{{font:14px sans-serif}}td{{padding:2px 8px}}.unguarded{{background:#fdd}}.guarded{{background:#dfd}}</style>"
        f"<h1>{esc(root)}</h1><table><tr><th>id<th>severity<th>guards<th>source<th>sink<th>layers{rows}</table><script type=application/json id=graph>{embed(small)}</script><script type=application/json id=findings>{embed(findings)}</script>"
    )


def scan_lines(findings: DataFrame) -> DataFrame:
    """line: a finding as text, for a terminal."""
    at = lambda end: F.concat(F.col(f"{end}_file"), F.lit(":"), F.col(f"{end}_line").cast("string"))
    mark = F.when(F.col("unguarded"), "UNGUARDED").otherwise(F.array_join("guards", ","))
    return findings.orderBy("id").select(F.format_string("[%s] %s %s -> %s %s (%s) %s", "severity", F.coalesce("cwe", F.lit("-")), at("source"), at("sink"), "sink_id", F.array_join("layers", ","), mark).alias("line"))
