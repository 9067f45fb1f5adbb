import json

import pytest
from pyspark.sql import functions as F

from ferrule.operators.binding import annotate
from ferrule.operators.findings import dedup_first, merge_guards
from ferrule.operators.paths import resolve, suffix_rescue
from ferrule.operators.serving import degrees, drawn_links, explain_layer, find_unguarded_sinks, get_function_taint, get_path_slice, list_paths, visible
from ferrule.plans import fixtures
from ferrule.plans.graph import communities
from ferrule.plans.project import analyze_ingest, analyze_project, embed, export, ingest, render_html, scan_lines
from ferrule.sources.files import known_files, read_tree, source_files, source_lines, stretches
from ferrule.sources.reports import first_place, read_reports
from ferrule.sources.rules import default_rules


@pytest.fixture(scope="module")
def done(spark):
    return ingest(fixtures.reports(spark), fixtures.tree(spark), root="/work/shop-project")


def place(uri, line=1):
    return {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}}


def raw(spark, kind, *data):
    docs = spark.createDataFrame([(i, f"{i}.json", kind, json.dumps(x)) for i, x in enumerate(data)], "doc long, path string, kind string, content string")
    return read_reports(docs).orderBy("doc", "run", "ord").collect()


def test_malformed_results_are_dropped_one_by_one(spark):
    results = [{"locations": ["oops"]}, {"ruleId": "ok", "locations": [place("a.py", "NaN")]}, {"locations": [place("a.py")], "codeFlows": [123]}, {}, {"locations": []}, 5, None, {"locations": [{"physicalLocation": []}]}]
    got = raw(spark, "sarif", {"runs": [{"results": results}, {}], "version": 1}, {})
    assert [x.problem for x in got] == ["parse-error", None, "parse-error", "sink-unbound", "sink-unbound", "parse-error", "parse-error", "parse-error"]
    assert got[1].sink.line == 1 and got[1].tool == "SARIF" and got[1].rule_id == "ok" and got[0].uri == "?"
    got = raw(spark, "semgrep", {"results": [{"path": "a", "start": {"line": 3}}, [], {"path": "b", "extra": 4}, {"path": "c", "check_id": 7}]}, {})
    assert [(x.problem, x.uri) for x in got] == [(None, None), ("parse-error", "?"), ("parse-error", "b"), ("parse-error", "c")]
    assert got[0].sink.line == 3 and got[0].rule_id == "semgrep"
    lines = raw(spark, "sarif", {"runs": [{"results": [{"locations": [place("a.py", x)]} for x in ("NaN", None, "7", 3.7, 10**12)]}]})
    assert [x.sink.line for x in lines] == [1, 1, 7, 3, 1]


def test_bases_rules_and_flows(spark):
    bases = {"A": {"uri": "file:///r/"}, "B": {"uri": "s%20x/", "uriBaseId": "A"}, "C": {"uri": "c/", "uriBaseId": "C"}}
    at = lambda b: {"physicalLocation": {"artifactLocation": {"uri": "f", "uriBaseId": b}}, "logicalLocations": [{"name": "short"}], "message": {"text": "said"}}
    results = [{"ruleId": "r", "locations": [at(b)], "taxa": [{"id": "CWE-1"}, 3]} for b in ("B", "C", "Z", None)]
    results.append({"ruleId": "r", "level": "note", "locations": [at("A")], "codeFlows": [{"threadFlows": [{"locations": [{"location": place("s.py", 2)}, {}]}]}, {}]})
    rules = [{"id": "r", "properties": {"tags": "one"}}, {"id": "r", "defaultConfiguration": {"level": "error"}, "properties": {"tags": ["a", "b"], "cwe": "CWE-7", "security-severity": 8.5}}]
    got = raw(spark, "sarif", {"runs": [{"tool": {"driver": {"name": "T", "version": "1", "rules": rules}}, "originalUriBaseIds": bases, "results": results}]})
    assert [x.sink.base for x in got] == ["/r/s x/", "c/", "", "", "/r/"]
    assert got[0].cwe_sources == ["CWE-1", "a", "b", "CWE-7", "r"] and got[0].level == "error" and got[0].security_severity == "8.5" and got[0].sink.fqn == "short" and got[0].sink.expr == "said" and got[0].tool == "T 1"
    assert got[4].level == "note" and got[4].alt_flows == 1 and got[4].has_flow and [(p.uri, p.line) for p in got[4].flow] == [("s.py", 2), ("", 1)]


def test_nested_places():
    at = {"path": "a.py", "start": {"line": 4}}
    found = lambda x: (p := first_place(x)) and (p["path"], p["line"], p["content"])
    assert found(["CliLoc", [at, "text"]]) == ("a.py", 4, "text") and found(["CliCall", [["CliLoc", [at, "t"]], [], None]]) == ("a.py", 4, "t")
    assert found({"location": at, "content": "c"}) == ("a.py", 4, "c") and found(at) == ("a.py", 4, None) and found(["x", []]) is None and found(None) is None
    deep = at
    for _ in range(3000):
        deep = [deep]
    assert found(deep) == ("a.py", 4, None)


def test_traces_of_semgrep(spark):
    at = lambda n: {"path": "a.py", "start": {"line": n}}
    trace = {"taint_source": ["CliCall", [["CliLoc", [at(2), "src"]], [], ["CliLoc", [at(9), "no"]]]], "intermediate_vars": [{"location": at(3), "content": "mid"}, {"nothing": 1}]}
    got = raw(spark, "semgrep", {"results": [{"check_id": "c", "path": "a.py", "start": {"line": 5}, "extra": {"dataflow_trace": trace, "lines": "x = 1"}}, {"path": "a.py", "extra": {"dataflow_trace": {"intermediate_vars": [at(3)]}}}]})
    assert [(p.uri, p.line, p.expr) for p in got[0].flow] == [("a.py", 2, "src"), ("a.py", 3, "mid")] and got[0].has_flow and got[0].sink.snippet == "x = 1"
    assert got[1].flow == [] and not got[1].has_flow


def test_a_document_that_is_no_json_is_an_error(spark):
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_reports(spark.createDataFrame([(0, "p", "sarif", "{")], "doc long, path string, kind string, content string")).collect()


def test_names_are_resolved_inside_the_root(spark):
    known = spark.createDataFrame([("a.py",), ("pkg/b.py",), ("pkg/c/d.py",), ("q/d.py",), ("x/__init__.py",), ("y/__init__.py",)], "path string")
    names = [("a.py", ""), ("./pkg/../a.py", ""), ("/root/pkg/b.py", ""), ("file:///root/pkg/b.py", ""), ("/other/pkg/b.py", ""), ("d.py", ""), ("old/c/d.py", ""), ("__init__.py", ""), ("../a.py", ""), ("../../etc/passwd", ""), ("", ""), (None, ""), ("b.py", "/root/pkg/"), ("b.py", "pkg"), ("/root-evil/z.py", ""), ("nothing.py", ""), ("/root/../etc/x", "")]
    got = {(r.uri, r.base): (r.file, r.reason) for r in resolve(spark.createDataFrame(names, "uri string, base string"), known, "/root").collect()}
    want = ["a.py", "a.py", "pkg/b.py", "pkg/b.py", "pkg/b.py", None, "pkg/c/d.py", None, "a.py", None, None, None, "pkg/b.py", "pkg/b.py", None, None, None]
    assert [got[n][0] for n in names] == want
    assert got["../../etc/passwd", ""][1] == "escapes-root" and got["", ""][1] == got[None, ""][1] == "no-uri" and got["nothing.py", ""][1] == "unmatched"
    assert suffix_rescue(spark.createDataFrame([("z/x/__init__.py",)], "name string"), known).first().file == "x/__init__.py"


def test_findings_of_the_fixture(done):
    f = {r.id: r for r in done.findings.collect()}
    assert len(f) == 5 and done.counts()["unguarded"] == 3 and done.counts()["binding"] == {"span": 4, "none": 1}
    one = f["path-0000"]
    assert [(h.file, h.line) for h in one.hops] == [("shop/web.py", 9), ("shop/store.py", 15), ("shop/store.py", 20)] and one.source_node == "shop/web.py:8" and one.sink_node == "shop/store.py:18"
    assert set(one.file_hashes) == {"shop/web.py", "shop/store.py"} and one.file_hashes["shop/web.py"].startswith("sha256:")
    assert {r.path: (r.n, r.tools) for r in done.inputs.collect()} == {"lens.sarif": (4, ["Lens 2.0", "Second"]), "semgrep.json": (2, ["Semgrep"])}


def test_first_row_wins_and_tools_are_kept(spark):
    rows = [(3, "k", "v3", ["a", "tool:Z"]), (1, "k", "v1", ["b", "tool:X"]), (2, "k", "v2", ["c", "tool:Y", "tool:X"]), (4, "m", None, [])]
    got = {r.k: r for r in dedup_first(spark.createDataFrame(rows, "rid int, k string, v string, provenance array<string>"), ("k",)).collect()}
    assert got["k"].v == "v1" and got["k"].provenance == ["b", "tool:X", "tool:Y", "tool:Z"] and got["m"].v is None
    g = merge_guards(spark.createDataFrame([("k", 1, ["a", "b"]), ("k", 2, ["b", "c"]), ("m", 1, []), ("n", 1, ["a"])], "k string, o int, guards array<string>"), ("k",), F.col("o"))
    assert {r.k: (r.o, r.guards) for r in g.collect()} == {"k": (1, ["b"]), "m": (1, []), "n": (1, ["a"])}


def test_views(spark, done):
    page, total = list_paths(done.findings, limit=2, offset=1)
    assert total.first().total == 5 and [r.id for r in page.collect()] == ["path-0001", "path-0002"]
    assert list_paths(done.findings, limit=-1)[0].count() == 0 and list_paths(done.findings, offset=9)[0].count() == 0
    assert [r.id for r in list_paths(done.findings, layer="credentials")[0].collect()] == ["path-0002"]
    assert [r.id for r in list_paths(done.findings, min_confidence="high", file="shop/web.py")[0].collect()] == ["path-0000", "path-0001", "path-0003"]
    rows, unknown = find_unguarded_sinks(done.findings, include_unknown=True)
    assert [r.id for r in rows.collect()][-1] == "path-0004" and unknown.first().unknown_count == 1 and find_unguarded_sinks(done.findings)[0].count() == 3
    assert [r.id for r in get_function_taint(done.findings, "shop/web.py:23").collect()] == ["path-0003"]
    assert visible(done.findings, ["credentials"], critical_only=True).first().id == "path-0002" and visible(done.findings, ["pii"]).count() == 0
    rules = default_rules()
    e = explain_layer(spark, "credentials", rules, done.nodes, done.findings).first()
    assert e.path_count == 1 and e.tagged_nodes == ["shop/store.py:23"] and "jwt" in e.provenance["secret_patterns"]
    assert explain_layer(spark, "nothing", rules, done.nodes, done.findings).first().provenance is None
    assert "login_required" in explain_layer(spark, "auth", rules, done.nodes, done.findings).first().provenance["decorators"]


def test_slices_tell_when_a_file_has_changed(spark, done):
    hashes = done.hashes.withColumn("hash", F.when(F.col("file") == "shop/web.py", "sha256:0").otherwise(F.col("hash"))).where("file <> 'shop/__init__.py'")
    s = get_path_slice(done.findings, "path-0000", done.lines, hashes, 0).collect()
    assert [(r.role, r.line, r.stale, r.mark) for r in s] == [("source", 9, True, True), ("hop", 15, False, True), ("sink", 20, False, True)]
    assert get_path_slice(done.findings, "no", done.lines, done.hashes).count() == 0


def test_trees_and_lines(spark, tmp_path):
    for name, text in {"a/b.py": "x\r\ny\x0cz\n", ".hid/c.py": "c", "venv/d.py": "1", "e.txt": "no end", "a/__pycache__/f.py": "1", "g.py": "g", "empty.py": "", "a/__init__.py": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    tree = read_tree(spark, str(tmp_path))
    assert {r.path for r in source_files(tree).collect()} == {"a/b.py", "g.py", "empty.py", "a/__init__.py"}
    assert {r.path for r in known_files(tree).collect()} == {"a/b.py", "a/__init__.py", ".hid/c.py", "e.txt", "g.py", "empty.py"}
    lines = [(r.file, r.n, r.text) for r in source_lines(tree.where("path not like '%/%' or path like 'a/b%'")).orderBy("file", "n").collect()]
    assert lines == [("a/b.py", 1, "x"), ("a/b.py", 2, "y"), ("a/b.py", 3, "z"), ("e.txt", 1, "no end"), ("g.py", 1, "g")]


def test_lines_of_long_files(spark):
    """A long file is split in stretches of whole lines: the same lines, no row with all of them."""
    text = "a\r\n\n\x0cb\u2028\u00e9" * 30 + "\n\nend"
    tree = spark.createDataFrame([("x.py", text.encode()), ("y", b"z\n"), ("w", b"\n\n" * 20)], "path string, content binary")
    some = stretches(tree, 16)
    assert some.selectExpr("max(length(content))").first()[0] <= 16 + 12 and some.where("path = 'x.py'").count() > 10
    got = sorted(tuple(x) for x in source_lines(tree, 16).collect())
    assert got == sorted((p, i + 1, line) for p, c in (("x.py", text), ("y", "z\n"), ("w", "\n\n" * 20)) for i, line in enumerate(c.splitlines()))


def test_from_a_folder_to_files(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    for name, text in fixtures.PROJECT.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(text)
    (tmp_path / "r.sarif").write_text(json.dumps(fixtures.SARIF))
    r = analyze_project(spark, str(src))
    out.mkdir()
    export(r, str(out), "<src>")
    data = json.loads((out / "findings.json").read_text())
    assert len(data["findings"]) == 5 and data["findings"][0]["id"] == "path-0000" and spark.read.parquet(f"{out}/findings").count() == 5
    page = (out / "map.html").read_text()
    assert "&lt;src&gt;" in page and "<src>" not in page
    graph = json.loads((out / "graph.json").read_text())
    assert len(graph["nodes"]) == r.nodes.count() and {x["relation"] for x in graph["links"]} == {"contains", "calls"} and all("sec_layers" in n for n in graph["nodes"])
    assert any("UNGUARDED" in x.line for x in scan_lines(r.findings).collect())
    i = analyze_ingest(spark, str(src), sarif=[str(tmp_path / "r.sarif")])
    assert i.findings.count() == 3 and i.inputs.first().kind == "sarif"
    with pytest.raises(ValueError):
        analyze_ingest(spark, str(src))


def test_graph_views(spark):
    links = spark.createDataFrame([("a", "a", "calls"), ("a", "b", "calls"), ("b", "z", "calls"), ("c", "d", "calls")], "source string, target string, relation string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    drawn = drawn_links(links, nodes)
    assert {r.id: r.degree for r in degrees(drawn).collect()} == {"a": 1, "b": 1, "c": 1, "d": 1}
    assert {r.id: r.community for r in communities(nodes, drawn).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}
    bound = spark.createDataFrame([(["x", "y"], "a", "b"), (["x"], "a", None)], "layers array<string>, source_node string, sink_node string")
    assert {r.id: r.sec_layers for r in annotate(nodes, bound).collect()} == {"a": ["x", "y"], "b": ["x", "y"], "c": [], "d": []}
    assert "</script>" not in embed({"a": "</script>"}) and "&lt;b&gt;" in render_html({"nodes": [], "links": []}, [], "<b>")


def test_parts_of_another_type_are_told_from_missing_ones(spark):
    """A part may be missing or null; one of another type makes its result malformed, in the sink and in the steps of a flow."""
    at = lambda **more: {"physicalLocation": {"artifactLocation": {"uri": "f"}, "region": {"startLine": 2}}, **more}
    flow = lambda *steps: [{"threadFlows": [{"locations": list(steps)}]}]
    fine = [{}, {"message": None}, {"partialFingerprints": None}, {"codeFlows": None}, {"codeFlows": flow({}, {"location": {}}, {"location": at(message=None)})}, {"codeFlows": [{}]}, {"locations": [at(logicalLocations=None)]}, {"locations": [{}]}]
    bad = [{"message": "m"}, {"partialFingerprints": []}, {"codeFlows": {}}, {"codeFlows": flow({"location": None})}, {"codeFlows": flow(5)}, {"codeFlows": flow({"location": at(message="m")})}, {"codeFlows": flow({"location": {"physicalLocation": {"region": 1}}})}]
    bad += [{"codeFlows": [{"threadFlows": 1}]}, {"codeFlows": [{"threadFlows": [1]}]}, {"codeFlows": [{"threadFlows": [{"locations": "x"}]}]}, {"locations": [at(logicalLocations={})]}, {"locations": [at(message=[])]}, {"locations": [{"physicalLocation": {"artifactLocation": 1}}]}]
    docs = spark.createDataFrame([(0, "p", "sarif", json.dumps({"runs": [{"results": [{"locations": [at()]} | x for x in fine + bad]}]}))], "doc long, path string, kind string, content string")
    for got in (read_reports(docs, ("sarif",)).orderBy("ord").collect(), read_reports(docs).orderBy("ord").collect()):
        assert [x.problem for x in got] == [None] * len(fine) + ["parse-error"] * len(bad)
        assert [len(x.flow) for x in got[: len(fine)]] == [0, 0, 0, 0, 3, 0, 0, 0]
