"""Source divergence against counting with dictionaries."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ferrule.llm import divergence
from ferrule.llm.divergence import audit, possible

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts, groups = Counter(), Counter(), {(lang, source) for _, lang, source in rows}
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        sources = [s for x, s in groups if x == lang]
        p = {}
        for s in [*sources, None]:
            c = {t: sum(counts[lang, x, t] for x in (sources if s is None else [s])) for t in kept}
            n = sum(c.values())
            p[s] = {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in sources:
            pair = [(t, sum(abs(p[s][x] - p[t][x]) for x in kept)) for t in sources if t != s]
            term = [(t, p[s][t] - p[None][t]) for t in kept if counts[lang, s, t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "text string, lang string, source string, term string")


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def rows_of(seed, n=400):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeé" for b in ("Word", "ß", "漢", "x", "-y", "7q", "ÀB", "\U0001f600")]
    return [(" ".join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=r.randint(0, 30))), r.choice(["en", "de", None]), r.choice(["s1", "s1", "s1", "s2", None, "é"])) for _ in range(n)]


@pytest.mark.parametrize("least,top,cells", [(30, 50, 1 << 20), (5, 3, 1 << 20), (20, 50, 8), (1000, 50, 1 << 20)])
def test_against_dictionaries(spark, least, top, cells):
    """Also with a sketch that is much too small, and where no term is kept."""
    rows = rows_of(least)
    want = brute(rows, least, top)
    assert got(audit(frame(spark, rows), least, top, cells)) == want and (least == 1000 or any(x[2] == "term" for x in want))


def test_odd_rows(spark):
    rows = [(None, "en", "a"), ("", "en", "b"), (None, None, None), ("7 8", "xx", "only"), ("same same", "de", "a"), ("same same", "de", "a"), ("Same", "de", "b")]
    for least in (1, 2, 3, 4):
        assert got(audit(frame(spark, rows), least)) == brute(rows, least)
    assert audit(frame(spark, [])).count() == 0
    long = [("wort " * 300_000 + "ende", "de", "a"), ("wort andere", "de", "b"), ("x" * 100_000, "de", "a")]
    assert got(audit(frame(spark, long), 1)) == brute(long, 1)


def test_tasks_hand_on_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    rows = rows_of(9)
    assert got(audit(frame(spark, rows), 5)) == brute(rows, 5)


def test_the_sketch_discards_but_never_what_counts(spark):
    counts = spark.range(3000).select(F.lit("en").alias("lang"), F.concat(F.lit("t"), "id").alias("term"), F.when(F.col("id") % 100 == 0, 40).otherwise(2).cast("long").alias("docs"))
    for width, most in ((1 << 16, 40), (1 << 10, 1500), (8, 3000)):
        left = {r.term for r in possible(counts, 30, width).collect()}
        assert {f"t{i}" for i in range(0, 3000, 100)} <= left and len(left) <= most
    halves = counts.withColumn("docs", F.col("docs") / 2).select("lang", "term", F.col("docs").cast("long"))
    assert {f"t{i}" for i in range(0, 3000, 100)} <= {r.term for r in possible(halves.union(halves), 30, 1 << 16).collect()}


def test_counts_beyond_longs(spark):
    df = spark.createDataFrame([(10**15, 10**16, 4)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")))
    assert df.first()[0] == 1 + 10**9 * (10**15 + 5) // (10**16 + 20)
