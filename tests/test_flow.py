"""Flow over graphs against searches node by node."""

import random

import pytest

from ferrule.operators.flow import dominators, immediate, immediate_dominators, proved, reaching_definitions
from ferrule.plans import state


def graphs(seed, count=25):
    """fn -> (edges, number of nodes): chains with partings, circles, nodes without a way, and a ring."""
    r = random.Random(seed)
    out = {}
    for fn in range(count):
        n = r.randint(1, 14)
        e = {(i, i + 1) for i in range(n - 1) if r.random() < 0.9} | {(r.randrange(n), r.randrange(n)) for _ in range(r.choice([0, 1, 3, 6]))}
        out[fn] = (e, n)
    return out | {count: ({(i, (i + 1) % 9) for i in range(9)}, 9)}


def ways(edges, start, stop=None, cut=frozenset()):
    """Nodes with a way from start that neither leaves `stop` nor takes a step of cut."""
    seen, todo = {start}, [start]
    while todo:
        a = todo.pop()
        for x, y in edges:
            if x == a and a != stop and (x, y) not in cut and y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def frames(spark, gs):
    steps = spark.createDataFrame([(fn, a, b) for fn, (e, _) in gs.items() for a, b in e] * 2 + [(0, None, 1)], "fn int, src int, dst int")
    return steps, spark.createDataFrame([(fn, 0) for fn in gs], "fn int, node int")


@pytest.mark.parametrize("seed", [1])
def test_reaching_definitions(spark, seed):
    gs, r = graphs(seed), random.Random(seed)
    defs = {(fn, v, r.randrange(n)) for fn, (_, n) in gs.items() for v in "xyz" for _ in range(r.randint(0, 3))} | {(0, f"v{i}", 0) for i in range(130)}
    want = set()
    for fn, v, s in defs:
        e, _ = gs[fn]
        todo = [b for a, b in e if a == s]
        seen = set(todo)
        while todo:
            a = todo.pop()
            if (fn, v, a) not in defs:
                new = {y for x, y in e if x == a} - seen
                seen |= new
                todo += new
        want |= {(fn, v, s, at) for at in seen}
    steps, _ = frames(spark, gs)
    df = reaching_definitions(steps, spark.createDataFrame(sorted(defs), "fn int, var string, site int"))
    assert "Python" not in df._jdf.queryExecution().toString()
    got = df.collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_dominators_by_removal(spark):
    gs = graphs(3)
    want = set()
    for fn, (e, n) in gs.items():
        there = ways(e, 0)
        want |= {(fn, a, d) for d in range(n) for a in there - ways(e, 0, stop=d) - {d}}
    steps, entries = frames(spark, gs)
    doms = dominators(steps, entries)
    got = doms.collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    for x in immediate(doms).collect():
        own = {d for fn, a, d in want if (fn, a) == (x.fn, x.node)}
        assert x.depth == len(own) and x.idom in own and own - {x.idom} == {d for fn, a, d in want if (fn, a) == (x.fn, x.idom)}


def test_proofs_hold_on_every_way(spark):
    gs, r = graphs(4), random.Random(4)
    proofs = {(fn, a, b, g) for fn, (e, _) in gs.items() for a, b in e for g in "pq" if r.random() < 0.3}
    want = set()
    for fn, (e, _) in gs.items():
        for g in "pq":
            want |= {(fn, a, g) for a in ways(e, 0) - ways(e, 0, cut={(a, b) for f, a, b, x in proofs if (f, x) == (fn, g)}) if any((f, x) == (fn, g) for f, _, _, x in proofs)}
    steps, entries = frames(spark, gs)
    got = proved(steps, entries, spark.createDataFrame(sorted(proofs), "fn int, src int, dst int, guard string")).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_long_ways_take_few_rounds(spark, monkeypatch):
    """2,000 nodes in a row: rounds follow the digits of the length, and a function's facts are spread over tasks."""
    made = []
    monkeypatch.setattr("ferrule.operators.flow.kept", lambda df, what: (made.append(what), state.kept(df, what))[1])
    monkeypatch.setattr("ferrule.operators.flow.watched", lambda df, what, **c: (made.append(what), state.watched(df, what, **c))[1])
    steps = spark.range(2000).selectExpr("0 AS fn", "id AS src", "id + 1 AS dst")
    out = reaching_definitions(steps, spark.createDataFrame([(0, "x", 3), (0, "x", 1500), (0, "y", 0)], "fn int, var string, site long"))
    assert {(x["var"], x.site): x["count"] for x in out.groupBy("var", "site").count().collect()} == {("x", 3): 1497, ("x", 1500): 500, ("y", 0): 2000}
    assert made.count("facts") < 16


@pytest.mark.parametrize("small", [0, 12, 1 << 20])
def test_functions_by_tasks_and_in_rounds(spark, monkeypatch, small):
    """Small functions are followed in tasks, the others in rounds, to the same end; no round is taken where all are small."""
    made = []
    monkeypatch.setattr("ferrule.operators.flow.SMALL", small)
    monkeypatch.setattr("ferrule.operators.flow.kept", lambda df, what: (made.append(what), state.kept(df, what))[1])
    gs = graphs(5)
    steps, entries = frames(spark, gs)
    want = {fn: {(fn, a, d) for d in range(n) for a in ways(e, 0) - ways(e, 0, stop=d) - {d}} for fn, (e, n) in gs.items()}
    doms = dominators(steps, entries)
    assert {tuple(x) for x in doms.collect()} == set().union(*want.values())
    assert ("small" in made, "known" in made) == (small > 0, small < 1 << 20)
    assert sorted(map(tuple, immediate_dominators(steps, entries).collect())) == sorted(map(tuple, immediate(doms).collect()))


def test_tables_of_rounds_are_not_broadcast(spark):
    """Spark would take the size of files for that of rows, and each of many rounds would send its tables through the driver."""
    for n in (9, 1 << 18):
        table = state.kept(spark.range(n).selectExpr("id", "id % 7 AS k"), "rows")
        both = spark.range(1 << 18).join(state.kept_paths([table, table]).where("k < 5").groupBy("id").count(), "id").join(table.select("id", "k"), "id")
        assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    none = spark.createDataFrame([], "fn int, src int, dst int")
    assert reaching_definitions(none, spark.createDataFrame([(0, "x", 1)], "fn int, var string, site int")).count() == 0
    assert dominators(none, spark.createDataFrame([(0, 0)], "fn int, node int")).count() == 0
    assert proved(none, spark.createDataFrame([(0, 0)], "fn int, node int"), spark.createDataFrame([], "fn int, src int, dst int, guard string")).count() == 0


def test_what_no_step_leads_to_is_taken_off_first(spark, monkeypatch):
    """Halves and thirds of numbers, with stops and without: all is taken from the front, and no round holds its facts against all others. With a circle at the end and a long way into it rounds are left with those."""
    made = []
    monkeypatch.setattr("ferrule.operators.flow.SMALL", 0)
    monkeypatch.setattr("ferrule.operators.flow.kept", lambda df, what: (made.append(what), state.kept(df, what))[1])
    halves = {(k, k // f) for k in range(1, 300) for f in (2, 3)}
    circle = {(0, -1), (-1, -2), (-2, 0)}
    way = {(1000 + i, 1001 + i) for i in range(400)} | {(1400, 0)}
    for fn, (edges, rounds) in enumerate([(halves, False), (halves | circle, True), (halves | way, True), (halves | way | circle, True)]):
        steps = spark.createDataFrame([(fn, a, b) for a, b in edges] * 2 + [(fn, None, 1), (None, 1, 2)], "fn int, src int, dst int")
        made.clear()
        defs = [(fn, v, s) for v, s in (("x", 299), ("x", 17), ("y", 150), ("y", 1), ("z", 1), ("z", 200))] + [(fn, f"v{i}", 256) for i in range(70)]
        got = reaching_definitions(steps, spark.createDataFrame(defs, "fn int, var string, site int")).collect()
        want = set()
        for _, v, s in defs:
            todo, seen, sites = [b for a, b in edges if a == s], set(), {x for _, w, x in defs if w == v}
            while todo:
                at = todo.pop()
                if at not in seen:
                    seen.add(at)
                    todo += [b for a, b in edges if a == at] if at not in sites else []
            want |= {(fn, v, s, at) for at in seen}
        assert {tuple(x) for x in got} == want and len(got) == len(want)
        assert "fronts" in made and ("known" in made) == rounds
