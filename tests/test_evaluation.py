import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ferrule.operators import evaluation as E
from ferrule.operators import prompts as P
from ferrule.operators.binding import bind, nearest_preceding, tightest_span
from ferrule.operators.closure import reachable, strong_components


def test_scores(spark):
    rows = [("real", True, "yes", "guarded", "sqli", "sqli", "high", "critical"), ("unsure", True, "unknown", "guarded", "", "sqli", None, "low"), ("false-positive", False, "no", "n/a", "cookie-injection", "insecure-cookie", "low", "critical"), (None, False, None, "unguarded", None, "x", "odd", "low")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, real boolean, g string, tg string, c string, tc string, s string, ts string").orderBy("i")
    c = F.col
    got = df.select(E.realfp_correct(c("v"), c("real")), E.guard_correct(c("g"), c("tg")), E.class_correct(c("c"), c("tc")), E.severity_distance(c("s"), c("ts"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True, 1), (False, False, False, None), (True, None, True, 3), (False, False, False, None)]


def test_mcnemar():
    assert E.mcnemar_p(5, 1) == 0.2188 and E.mcnemar_p(0, 0) == 1.0 and E.mcnemar_p(3, 3) == 1.0 and E.mcnemar_p(0, 10) == round(2 / 1024, 4)


def test_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([(x,) for x in [1] * 30 + [0] * 10], "x int")
    r = E.bootstrap_ci(df, "x", 2000).first()
    assert r.point == 0.75 and 0.5 < r.lo < 0.7 and 0.8 < r.hi < 0.95
    assert tuple(E.bootstrap_ci(df.where("false"), "x").first()) == (0.0, 0.0, 0.0)


def test_bootstrap_of_the_whole_table(spark, tmp_path):
    """Ids beyond any first few decide, and many items cost no more than few."""
    from ferrule.plans import queries

    spark.range(2_000_000).selectExpr("id AS doc_id", "CASE WHEN id < 60 THEN 0 ELSE id % 4 END AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    r = queries.bootstrap_interval(spark, str(tmp_path)).first()
    assert r.point == 1.5 and 1.49 < r.lo < r.point < r.hi < 1.51  # 1.96 standard errors are 0.0015
    assert 0.002 < r.hi - r.lo < 0.004


def test_rankings_and_audit(spark):
    r = spark.createDataFrame([(1, False), (2, True), (3, True)], "pos int, hit boolean")
    assert E.rank_of_first(r).first().first == 2 and tuple(E.precision_at(r, 2).first()) == (1, 2) and tuple(E.precision_at(r, 10).first()) == (2, 3)
    a = spark.createDataFrame([("analyzed", True, "unguarded"), ("analyzed", True, "guarded"), ("analyzed", False, "guarded"), ("unknown", True, "guarded"), ("analyzed", True, "n/a")], "guard_status string, unguarded boolean, truth string")
    assert tuple(E.self_audit(a).first()) == (1, 1, 1, 0, 1, 0.5, 1.0)
    d = spark.createDataFrame([("k", 0, "a"), ("k", 1, "a"), ("m", 0, "a"), ("m", 1, None), ("n", 0, "a")], "k string, run int, verdict string")
    assert tuple(E.decode_agreement(d, ["k"]).first()) == (1, 2)


def test_prompts(spark):
    w = spark.createDataFrame([("p", 0, "source", "a.py", 2, True, 1, "x", False), ("p", 0, "source", "a.py", 2, True, 2, "y", True), ("p", 1, "sink", "b.py", 1, False, 1, "z", True)], "id string, ord int, role string, file string, line int, stale boolean, n int, text string, mark boolean")
    e = P.excerpts(w)
    assert e.first().excerpts == "[source] a.py, line 2 (changed since it was analyzed)\n      1 | x\n*     2 | y\n\n[sink] b.py, line 1\n*     1 | z"
    s = spark.createDataFrame([("p", "CWE-1", "high", "s @ a.py:2", "k @ b.py:1", ["pii"], "low", True, "analyzed", [])], "id string, cwe string, severity string, source string, sink string, layers array<string>, confidence string, unguarded boolean, guard_status string, guards array<string>")
    rich, bare = P.finding_prompts(s, e, True).first().prompt, P.finding_prompts(s, e, False).first().prompt
    assert "Kinds of data: pii" in rich and "Barriers on every way: none" in rich and "pii" not in bare and "Confidence" not in bare and bare.endswith("z")
    review = P.review_prompts(s, e).first().prompt
    assert review.startswith(rich) and review.endswith(P.QUESTIONS[-1])
    lines = spark.createDataFrame([("a.py", 1, "x"), ("a.py", 2, "y")], "file string, n int, text string")
    text = P.whole_files(spark.createDataFrame([("p", "a.py"), ("p", "gone")], "id string, file string"), lines).first().files
    assert "     1 | x\n      2 | y" in text and "gone:\n(it can't be read)" in text
    place = "struct<uri:string,base:string,line:int,snippet:string,fqn:string,expr:string>"
    r = spark.createDataFrame([("p", "r1", "Looks for q.", "Looks for q.", "warning", "7.5", "Bad.", ("a.py", "", 2, None, None, ""), [("a.py", "", 1, None, None, "start"), ("a.py", "", 2, None, None, "")])], f"id string, rule_id string, rule_text string, rule_help string, severity string, security_severity string, message string, sink {place}, flow array<{place}>")
    got = P.report_prompts(r, lines).first().prompt
    assert got.count("Looks for q.") == 1 and "Its message: Bad." in got and "- a.py:1 start\n- a.py:2\n" in got and got.endswith("     2 | y")
    x = spark.createDataFrame([("pii", {"identifiers": ["email"]}, [], 3), ("no", None, [], 0), ("auth", {"decorators": []}, ["n1"], 2)], "layer string, provenance map<string,array<string>>, tagged_nodes array<string>, path_count long")
    told = {r.layer: r.prompt for r in P.layer_prompt(x).collect()}
    assert "- identifiers: email" in told["pii"] and "3 paths" in told["pii"] and "has no kind of data 'no'" in told["no"] and "marks n1" in told["auth"]


def test_mcnemar_terms():
    import math

    for a, b in [(0, 0), (5, 1), (1, 5), (10, 10), (0, 40), (300, 220), (1000, 1100), (60_000, 59_000)]:
        n = a + b
        want = 1.0 if not n else round(min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(min(a, b) + 1)), 2**n))), 4) if n < 5000 else E.mcnemar_p(b, a)
        assert abs(E.mcnemar_p(a, b) - want) < 2e-4


def test_missing_verdicts_are_wrong(spark):
    v = [("r", "f", 1, "A", "real", "yes", "x", "low", 1.0, 1.0), ("r", "f", 2, "A", "real", "yes", "x", "low", 1.0, 1.0), ("r", "f", 1, "B", "real", "yes", "x", "low", 1.0, 1.0)]
    verdicts = spark.createDataFrame(v, "rule_id string, file string, line int, arm string, verdict string, auth_guarded string, vuln_class string, severity string, prompt_tokens double, wall_s double")
    truth = spark.createDataFrame([("r", "f", n, True, "x", "guarded", "low") for n in (1, 2, 3)], "rule_id string, file string, line int, real boolean, vuln_class string, guard string, severity string")
    got = {x.arm: x for x in E.arm_scores(verdicts, truth).collect()}
    assert (got["A"].n, got["A"].realfp, got["B"].n, got["B"].realfp, got["B"].guard, got["B"]["class"]) == (2, 1.0, 2, 0.5, 0.5, 0.5)


def test_binding_prefers_the_tightest_then_the_nearest(spark):
    p = spark.createDataFrame([(1, "f", 5), (2, "f", 30), (3, "g", 1), (4, "h", 1), (5, "f", 2)], "id int, file string, line int")
    s = spark.createDataFrame([("f", 1, 20, "outer"), ("f", 4, 6, "inner"), ("f", 4, 9, "twin")], "file string, start int, end int, node string")
    d = spark.createDataFrame([("f", 4, "inner"), ("f", 25, "late"), ("f", 99, "after")], "file string, def_line int, node string")
    assert {r.id: r.node for r in tightest_span(p, s).collect()} == {1: "inner", 5: "outer"}
    assert {r.id: r.node for r in nearest_preceding(p, d).collect()} == {1: "inner", 2: "late"}
    f = spark.createDataFrame([("g", "file-g")], "file string, node string")
    assert {r.id: (r.node, r.method) for r in bind(p, s, d, f).collect()} == {1: ("inner", "span"), 2: ("late", "nearest-def"), 3: ("file-g", "file"), 4: (None, "none"), 5: ("outer", "span")}


def test_closure(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src long, dst long")
    assert {(r.src, r.dst) for r in reachable(e).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)} | {(5, 5)}
    assert {r.dst for r in reachable(e, spark.createDataFrame([(4,)], "src long")).collect()} == set()
    assert {r.node: r.component for r in strong_components(e).collect()} == {1: 1, 2: 1, 3: 1, 5: 5}
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 6), (60, 60), (61, 62)], "src long, dst long")
    assert reachable(chain).count() == sum(9 - i for i in range(6)) + 4 * 4 + 2 and reachable(chain, spark.createDataFrame([(7,)], "src long")).count() == 4
    assert {r.node: r.component for r in strong_components(chain).collect()} == {6: 6, 7: 6, 8: 6, 9: 6, 60: 60}
    rnd = random.Random(4)
    for n in (7,):
        pairs = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(int(1.5 * n))}
        reach = set(pairs)
        while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
            reach |= more
        df = spark.createDataFrame(sorted(pairs), "src long, dst long")
        assert {tuple(r) for r in reachable(df).collect()} == reach
        want = {a: min(b for a2, b in reach if a2 == a and (b, a) in reach) for a, b in reach if (b, a) in reach}
        assert {r.node: r.component for r in strong_components(df).collect()} == want
    assert strong_components(chain.where("false")).count() == reachable(chain.where("false")).count() == 0


def test_binding_against_brute_force(spark):
    import random

    r = random.Random(2)
    p = [(i, r.choice("fg"), r.randint(-5, 3000)) for i in range(400)]
    s = [(r.choice("fg"), a := r.randint(0, 3000), a + r.choice([-1, 0, 1, 7, 8, 100, 2500]), f"n{i:03}") for i in range(200)]
    d = [(r.choice("fg"), r.randint(0, 3000), f"d{i:03}") for i in range(60)]
    points = spark.createDataFrame(p, "id int, file string, line int")
    spans = {i: max(((a, n) for f, a, b, n in s if f == k and a <= x <= b), key=lambda t: (t[0], [-ord(c) for c in t[1]]), default=(0, None))[1] for i, k, x in p}
    got = {x.id: x.node for x in tightest_span(points, spark.createDataFrame(s, "file string, start int, end int, node string")).collect()}
    assert got == {i: n for i, n in spans.items() if n}
    near = {i: min((n for f, a, n in d if f == k and a == max((b for g, b, _ in d if g == k and b <= x), default=None)), default=None) for i, k, x in p}
    for width in (64, 1 << 14):
        got = {x.id: x.node for x in nearest_preceding(points, spark.createDataFrame(d, "file string, def_line int, node string"), width=width).collect()}
        assert got == {i: n for i, n in near.items() if n}
    none = spark.createDataFrame([], "file string, start int, end int, node string")
    assert tightest_span(points, none).count() == 0



def test_spans_that_all_lie_around_all_points(spark):
    """4,000 points in 4,000 spans: 16 million pairs, of which no join makes more than some rows a point and a size."""
    points = spark.range(4000).selectExpr("id", "'f' AS file", "id + 4000 AS line")
    spans = spark.range(4000).selectExpr("'f' AS file", "id AS start", "id + 8000 AS end", "id AS node")
    out = tightest_span(points, spans)
    out.collect()
    rows = []
    todo = [out._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName():
            rows.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
    assert rows and max(rows) <= 4000 * 14
    assert all(x.node == min(x.id + 4000, 3999) for x in out.collect())


def test_paired_difference(spark):
    """The interval is the normal one within sampling error, the same again, and of as many values as there are rows."""
    rows = [(i, float(i % 7) / 7 + i / 1e6, float(i * 5 % 11) / 11) for i in range(4000)] + [(None, 1.0, None), (9, None, 1.0)]
    df = spark.createDataFrame(rows, "item long, a double, b double")
    r = E.paired_difference(df, "item", "a", "b").first()
    x = [b - a for _, a, b in rows[:4000]]
    mean = sum(x) / 4000
    se = (sum((v - mean) ** 2 for v in x) / 4000 / 4000) ** 0.5
    assert r.n == 4000 and abs(r.difference - mean) < 1e-12 and abs(r.standard_error - se) < 1e-9
    assert abs(r.lo - (mean - 1.96 * se)) < 0.25 * se and abs(r.hi - (mean + 1.96 * se)) < 0.25 * se
    assert (r.a_only, r.b_only) == (sum(v < 0 for v in x), sum(v > 0 for v in x)) and r.p_value == E.mcnemar_p(r.a_only, r.b_only)
    again = E.paired_difference(df.repartition(7), "item", "a", "b").first()
    assert abs(again.lo - r.lo) < 1e-9 and abs(again.hi - r.hi) < 1e-9
    none = E.paired_difference(df.where("false"), "item", "a", "b").first()
    assert none.n == 0 and none.lo is None and none.p_value == 1.0


def test_poisson_weights():
    import numpy as np

    w = E.poisson_weights(np.arange(3000, dtype=np.int64), 400)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08


def test_first_hits_and_top_hits_without_positions(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(5), r.random() < 0.1) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, score long, hit boolean")
    keys = [-F.col("score"), F.col("id")]
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    assert E.first_hit(df, keys).first().first == 1 + next(i for i, x in enumerate(order) if x[2])
    for k in (1, 7, 100):
        assert tuple(E.top_hits(df, keys, k).first()) == (sum(x[2] for x in order[:k]), min(k, 60))
    none = df.where("not hit")
    assert E.first_hit(none, keys).first().first is None and E.first_hit(df.where("false"), keys).first().first is None and tuple(E.top_hits(df.where("false"), keys, 3).first()) == (0, 0)
