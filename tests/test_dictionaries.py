"""Dictionaries as tables against the expressions for small ones, and against one test for each entry."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ferrule.functions import labels as L
from ferrule.operators import dictionaries as D
from ferrule.sources.rules import Rules, default_rules

WORDS = ["api", "key", "keys", "pass", "passes", "class", "es", "s", "box", "boxes", "tax", "id", "ids", "user", "Name", "x1"]


def random_names(r, n):
    return ["".join(r.choice(["_", "-", "", ".", "__"]) + (w.title() if r.random() < 0.5 else w) for w in r.choices(WORDS, k=r.randint(0, 6))) for _ in range(n)]


def test_names_as_the_expression_has_them(spark):
    r = random.Random(3)
    labels = {f"l{i}": {"identifiers": ["_".join(r.choices(WORDS, k=r.randint(1, 3))).lower() for _ in range(4)] + ["-", "Tax--ID"][: i % 3], "confidence": "low"} for i in range(6)}
    labels = {k: {**v, "identifiers": [t for t in v["identifiers"] if t != "-"]} for k, v in labels.items()}
    names = [*random_names(r, 300), None, "", "___", "password", "ß_key", "s", "es", "APIKeys"]
    df = spark.createDataFrame([(i, n, 0) for i, n in enumerate(names)], "i int, n string, run int")
    index = D.term_index(spark.createDataFrame([(k, t) for k, v in labels.items() for t in v["identifiers"]] + [("l0", "-"), ("l1", None), (None, "api")], "layer string, term string"))
    want = {x.i: x.y for x in df.select("i", L.ident_layers(F.col("n"), Rules(labels=labels)).alias("y")).collect()}
    got = D.layers_of(df, "n", index).collect()
    assert {x.i: x.layers for x in got} == want and len(got) == len(names) and got[0].run == 0
    assert sum(map(len, want.values())) > 100


def test_the_shipped_pack(spark):
    rules = default_rules()
    terms = [(k, t) for k, v in rules.labels.items() for t in v["identifiers"]]
    names = ["dbPassword", "passwords", "email_addresses", "credit_card", "salt", "tokenizer", "token", "passport_secret"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {x.n: x.layers for x in D.name_layers(df, "n", D.term_index(spark.createDataFrame(terms, "layer string, term string"))).collect()}
    assert got == {x.n: x.y for x in df.select("n", L.ident_layers(F.col("n"), rules).alias("y")).collect()}


def test_empty_dictionaries(spark):
    df = spark.createDataFrame([("a",), (None,)], "n string")
    none = D.term_index(spark.createDataFrame([], "layer string, term string"))
    assert {x.n: x.layers for x in D.layers_of(df, "n", none).collect()} == {"a": [], None: []}
    empty = spark.createDataFrame([], "id string, ord int, anchor string, regex string")
    assert D.first_pattern(df.withColumn("k", F.lit(1)), "k", "n", empty).count() == 0


def test_plans_do_not_grow_with_the_dictionary(spark):
    df = spark.createDataFrame([("user_a17",), ("b",)], "n string")
    sizes = []
    for n in (10, 10_000):
        index = D.term_index(spark.range(n).select((F.col("id") % 7).cast("string").alias("layer"), F.concat(F.lit("a"), "id").alias("term")))
        plan = D.name_layers(df, "n", index)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(re.sub(r"\d+|[0-9a-f]{32}", "", plan)))
    assert sizes[0] == sizes[1]
    assert {x.n: x.layers for x in D.name_layers(df, "n", index).collect()} == {"user_a17": ["3"], "b": []}


def test_first_patterns(spark):
    r = random.Random(8)
    anchors = ["".join(r.choices("ab", k=r.randint(4, 7))) for _ in range(60)]
    patterns = [(f"p{i}", 1000 - i, a, re.escape(a) + r.choice(["", "[0-9]+", "[ab]{3}", "$"])) for i, a in enumerate(anchors)]
    texts = [(i, "".join(r.choices("ab0 ", weights=[5, 5, 1, 1], k=r.randint(0, 40)))) for i in range(150)] + [(500, None), (501, ""), (502, "abc"), (503, "x" * 300_000 + anchors[0] + "0")]
    want = {}
    for i, text in texts:
        for p, o, _, regex in sorted(patterns, key=lambda p: p[1]):
            if text and (m := re.search(regex, text)):
                want[i] = (p, m.group())
                break
    df = spark.createDataFrame(texts, "k int, t string").withColumn("id", F.lit("clash"))
    pats = spark.createDataFrame(patterns, "id string, ord int, anchor string, regex string")
    got = D.first_pattern(df, "k", "t", pats, 4).collect()
    assert {x.k: (x.id, x.match) for x in got} == want and len(got) == len(want) > 50
    with pytest.raises(ValueError, match="anchor"):
        D.first_pattern(df, "k", "t", pats, 6)


def test_large_dictionaries_do_not_go_through_the_driver(spark):
    """Of 60,000 patterns a bitmap alone is broadcast, of 60,000 terms nothing."""
    ids = spark.range(60_000).selectExpr("id", "id AS ord", "left(md5(CAST(id AS STRING)), 8) AS anchor")
    patterns = ids.selectExpr("id", "ord", "anchor", "concat(anchor, '-[0-9]+') AS regex")
    texts = ids.where("id % 1000 = 0").selectExpr("id AS k", "concat('by ', anchor, '-12; and ', anchor, '_x') AS text")
    found = D.first_pattern(texts, "k", "text", patterns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_gram" in plan and "BroadcastHashJoin [_word" in plan and "BroadcastHashJoin [_gram" not in plan
    assert {(x.k, x.id) for x in found.collect()} == {(i, i) for i in range(0, 60_000, 1000)}
    index = D.term_index(ids.selectExpr("CAST(id % 3 AS STRING) AS layer", "concat('a_', anchor) AS term"))
    layers = D.name_layers(ids.where("id % 1000 = 1").selectExpr("concat('my_a_', anchor, 's') AS name"), "name", index)
    assert "_salt" not in "".join(x for x in layers._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x)
    assert all(len(x.layers) == 1 for x in layers.collect())
