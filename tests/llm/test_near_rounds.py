"""How many rows the rounds of near-dedup make, and its SimHash step."""

import random

import numpy as np
from pyspark.sql import functions as F

from ferrule.llm.common import written
from ferrule.llm.near_sets import NearSets, near_duplicates, simhash
from tests.llm.test_near_sets import varied


def test_leaders_of_two_lists_a_set(spark):
    """A group that shares forty lists costs six rows a set, not three for each list."""
    many = spark.range(200).select(F.col("id").alias("sid"), F.lit(10).cast("long").alias("n"), F.lit(10).cast("long").alias("left"), F.lit(200).cast("long").alias("size"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("k"))
    led = NearSets(None, None, 3, 0.85, 32).led(many)
    assert led.count() <= 6 * 200
    assert {x for r in led.collect() for x in (r.u, r.v)} == set(range(200))


def test_long_lists_are_settled_before_any_round(spark, documents, monkeypatch):
    """Sixty texts with a passage that no sample has seen: the lists already have its members last, so there are no further rounds."""
    r = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(passage + [f"w{r.randrange(10**6)}" for _ in range(100)]) for _ in range(60)]
    monkeypatch.setattr("ferrule.llm.near_sets.common_shingles", lambda *a, **k: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    sizes, lists = [], NearSets.lists
    monkeypatch.setattr(NearSets, "lists", lambda self, now: sizes.append((out := lists(self, now)).where("size > 32").count()) or out)
    assert [x.component_id for x in near_duplicates(documents(texts)).orderBy("doc_id").collect()] == list(range(60))
    assert sizes == [0]


def test_simhash_step_links_near_copies(spark, documents, monkeypatch):
    assert simhash(np.array([5, 7, 12], np.int64)) == 5 and simhash(np.zeros(0, np.int64)) == 0
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(base), varied(r, base, 1), " ".join(f"v{r.randrange(10**6)}" for _ in range(300))]
    found, step = [], NearSets.fingerprinted
    monkeypatch.setattr(NearSets, "fingerprinted", lambda self: found.append(out := written(step(self), "test")) or out)
    assert [x.component_id for x in near_duplicates(documents(texts)).orderBy("doc_id").collect()] == [0, 0, 2]
    assert found[0].count() == 1
