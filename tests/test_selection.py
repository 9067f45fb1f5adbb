"""Exact ranks of groups of any size against sorting."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ferrule.operators import selection
from ferrule.operators.selection import at_ranks, medians


def groups():
    r = random.Random(5)
    out = {"one": [3.5], "two": [1.0, 2.0], "equal": [7.0] * 900, "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(1500)], "even": [float(r.randint(0, 9)) for _ in range(1200)]}
    # The two in the middle differ, and one of them stands in half of all rows.
    out["half"] = [5.0] * 1000 + [5.0 + r.random() for _ in range(1000)]
    out[None] = [r.gauss(0, 1) for _ in range(1001)]
    return out


@pytest.mark.parametrize("bound", [8, 300, 10_000])
def test_medians_of_groups_of_all_sizes(spark, bound):
    of = groups()
    rows = [(k, x) for k, v in of.items() for x in v] + [("one", None), ("nulls", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: (r.n, r.median) for r in medians(df, ["g"], "x", bound).collect()}
    assert got == {k: (len(v), statistics.median(v)) for k, v in of.items()}


def test_ranks_that_are_asked_for(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("a"), F.lit(None).cast("int").alias("b"), ((F.col("id") * 7919) % 3001).cast("int").alias("rank_value"))
    want = {(a, k): sorted((i * 7919) % 3001 for i in range(3000) if i % 2 == a)[k] for a in (0, 1) for k in (0, 1, 700, 1498, 1499)}
    asked = spark.createDataFrame([(a, None, k) for a, k in want] + [(0, None, 0), (1, None, 1500), (1, None, -1), (9, None, 0)], "a long, b int, rank int")
    got = at_ranks(rows, asked, ["a", "b"], "rank_value", 20).collect()
    assert {(r.a, r["rank"]): r.rank_value for r in got} == want and len(got) == len(want)


def test_no_rows(spark):
    assert medians(spark.createDataFrame([], "g string, x int"), ["g"], "x").count() == 0


def test_large_numbers(spark):
    asked = spark.createDataFrame([(1, 499)], "g int, rank int")
    for first, step in ((2**60, 1), (-(2**63), 18 * 10**15)):  # one after the other, and over all longs
        rows = spark.range(999).select(F.lit(1).alias("g"), F.expr(f"CAST(CAST({first} AS DECIMAL(38, 0)) + id * CAST({step} AS DECIMAL(18, 0)) AS LONG)").alias("x"))
        assert at_ranks(rows, asked, ["g"], "x", 50).first().x == first + 499 * step
    with pytest.raises(TypeError):
        at_ranks(rows.withColumn("x", F.col("x").cast("string")), asked, ["g"], "x")


def test_rows_of_large_groups_are_not_shuffled(spark, monkeypatch):
    """What is known of a few large groups goes to the rows: these are neither dealt nor sorted for it, and two ranks of a group share its rows. Only what is left in the end is sorted."""
    plans = []
    noted = lambda f: lambda df, *a, **b: (plans.append(df._jdf.queryExecution().executedPlan().toString()), f(df, *a, **b))[1]
    monkeypatch.setattr(selection, "kept", noted(selection.kept))
    monkeypatch.setattr(selection, "watched", noted(selection.watched))
    # One group has most of the rows.
    rows = spark.range(4000).select(F.when(F.col("id") % 10 == 0, "few").otherwise("hot").alias("g"), ((F.col("id") * 7919) % 4001).cast("double").alias("x"))
    want = {g: sorted(float((i * 7919) % 4001) for i in range(4000) if (i % 10 == 0) == (g == "few")) for g in ("few", "hot")}
    got = {r.g: r.median for r in medians(rows, ["g"], "x", 50).collect()}
    assert got == {g: statistics.median(v) for g, v in want.items()}
    assert not [p for p in plans if "_salt" in p] and sum("BroadcastHashJoin" in p for p in plans) >= 3
    joins = [p for p in plans if "SortMergeJoin" in p]
    assert all("percentile_approx" in p for p in joins)  # a row per group and rank


@pytest.mark.parametrize("few", [0, 4096])
def test_many_large_groups_are_dealt_with_their_rows(spark, monkeypatch, few):
    """Null keys, null and repeated values, NaN, a group without values, ranks that aren't there or are asked for twice: alike whether groups are few or many."""
    monkeypatch.setattr(selection, "FEW", few)
    r = random.Random(3)
    of = {(None, 1): [r.gauss(0, 1) for _ in range(700)], (None, None): [5.0] * 300, ("a", None): [float(r.randint(0, 3)) for _ in range(500)] + [float("nan")] * 200, ("a", 2): [1.0, 2.0], ("b", 0): [r.random() for _ in range(901)] * 2}
    rows = [(*k, x) for k, v in of.items() for x in v] + [("a", 2, None), ("none", None, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(5)
    plain = lambda x: "nan" if x != x else x
    ordered = {k: sorted(v, key=lambda x: (x != x, x)) for k, v in of.items()}
    ranks = [(*k, i) for k, v in of.items() for i in {0, len(v) // 3, len(v) - 1}]
    asked = spark.createDataFrame([*ranks, *ranks[:2], ("a", 2, 2), ("b", 0, -1), ("b", 0, None), ("none", None, 0)], "g string, h int, rank int")
    got = at_ranks(df, asked, ["g", "h"], "x", 40).collect()
    assert sorted(map(str, ((x.g, x.h, x["rank"], plain(x.x)) for x in got))) == sorted(map(str, ((g, h, i, plain(ordered[g, h][i])) for g, h, i in ranks)))
    found = {(x.g, x.h): (x.n, plain(x.median)) for x in medians(df, ["g", "h"], "x", 40).collect()}
    middle = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert found == {k: (len(v), plain(middle(v))) for k, v in ordered.items()}
