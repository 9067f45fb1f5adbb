r"""Source divergence audit: how the use of words differs between the sources of a language, with counts behind a sketch.

Terms are runs of letters (A-Z and a-z as a-z, and all characters beyond ASCII). A language keeps the terms of at least `least` of its documents.
Each task counts its own documents' terms by language and source, in parts of bounded size. From these parts a count-min sketch of document
frequencies is merged: every term adds its documents to one cell in each of several rows of cells, so no cell underestimates a term, and a term that meets one cell below
`least` can't be kept. Such terms are discarded before anything of theirs is shuffled; what survives is counted exactly, and the exact count decides. The
number of cells follows the number of counts and only bears on what the filter saves.

With p = 1 + floor(10^9 (count + 5) / (N + 5 V)), the sum of |p - q| over all V terms is joined sparsely: terms that neither source has differ by the same base values, so two sources
meet only in terms that both have; for a term that one of them has, the difference to the other's base depends on its count alone, so these
are summed over the distinct counts of a source.

Defined results: null text, lang and source are ''. Every row is a document, repeated rows too. A group of documents without kept terms has count 0 for all. A language without kept terms has
pairs of value 0 and no term rows; a language of one source has no pairs. Ties go to the smaller item by UTF-8. A very long text is counted in the task that has its row.
An empty table gives an empty result. Only text, lang and source are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import discard, sized, table, written

#: On UTF-8: bytes of 128 and more only stand in characters beyond ASCII.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Entries that a task holds before it hands them on.
HELD = 200_000
#: One document, beside a count of occurrences below it; a part has fewer words than that.
DOC = 1 << 32
#: Rows of cells of the sketch.
DEPTH = 3


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: of each task's documents, a term several times if need be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A term's occurrences are in the low half of a number, its documents in the high half.
        groups: dict[tuple[str, str], dict[bytes, int]] = {}
        held = words = 0

        def out() -> pa.RecordBatch:
            sizes = [len(own) for own in groups.values()]
            both = np.fromiter(chain.from_iterable(own.values() for own in groups.values()), np.int64, sum(sizes))
            of = lambda k: pa.array(list(chain.from_iterable(repeat(g[k], n) for g, n in zip(groups, sizes))), pa.string())
            terms = pa.array(list(chain.from_iterable(groups.values())), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([of(0), of(1), terms, pa.array(both & (DOC - 1)), pa.array(both >> 32)], names=["lang", "source", "term", "count", "docs"])

        for b in batches:
            for text, lang, source in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = groups.setdefault((lang, source), {})
                before, found = len(own), TERM.findall(text.as_buffer().to_pybytes().lower())
                for t, n in Counter(found).items():
                    own[t] = own.get(t, 0) + n + DOC
                held, words = held + len(own) - before, words + len(found)
                if held >= HELD or words >= DOC >> 2:
                    yield out()
                    groups.clear()
                    held = words = 0
        yield out()

    return docs.select(F.col("text").cast("binary"), "lang", "source").mapInArrow(run, "lang string, source string, term string, count long, docs long")


def cell(depth: int, width: int) -> Column:
    return F.pmod(F.xxhash64("lang", "term", F.lit(depth)), F.lit(width)) * DEPTH + depth


def possible(counts: DataFrame, least: int, width: int) -> DataFrame:
    """Those of counts (lang, term, docs, and others) of which no cell of the merged sketch rules out that the term has `least` documents in its language."""
    sketch = counts.select(F.explode(F.array(*[cell(i, width) for i in range(DEPTH)])).alias("cell"), "docs").groupBy("cell").agg(F.sum("docs").alias("n")).where(F.col("n") >= least)
    full = written(sketch.select("cell"), "sketch")
    for i in range(DEPTH):
        # At most `width` cells of a row of the sketch, of a long each.
        own = F.broadcast(full.where(F.pmod("cell", F.lit(DEPTH)) == i).select(F.col("cell").alias("own")))
        counts = counts.join(own, cell(i, width) == F.col("own"), "left_semi")
    return counts


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 v)), in decimals: exact beyond what longs hold."""
    wide = lambda x, digits: x.cast(f"decimal({digits},0)")
    return F.call_function("div", wide(F.lit(10**9), 10) * wide(count + 5, 19), wide(total + 5 * v, 20)) + 1


def audit(docs: DataFrame, least: int = 30, top: int = 50, most_cells: int = 1 << 20) -> DataFrame:
    """lang, source, part, item, value, rank."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = written(texts.groupBy("lang", "source").agg(F.count("*").alias("rows")).select("lang", "source"), "groups")
    parts = written(sized(partial_counts(texts), docs), "counts")
    width = min(most_cells, 1 << max(12, (parts.count() // 4).bit_length()))
    exact = written(possible(parts, least, width).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "exact")
    kept = written(exact.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("whole")).where(F.col("docs") >= least).select("lang", "term", "whole"), "terms")
    discard(parts)

    langs = groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("all")), "lang", "left").na.fill(0)
    own = exact.join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "whole")
    # base: what a term has of which the group has none.
    sizes = groups.join(own.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("has")), ["lang", "source"], "left").na.fill(0).join(langs, "lang")
    sizes = written(sizes.select("*", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("n"), F.col("v"))).alias("base")), "sizes")
    p = written(
        own.join(sizes, ["lang", "source"]).select("lang", "source", "term", "count", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("whole"), F.col("all"), F.col("v")).alias("q")), "shares"
    )
    discard(exact, kept)

    # Terms that both have, at first as if each had been compared with the other's base.
    a, b = sizes.select("lang", F.col("source").alias("a"), F.col("base").alias("base_a"), F.col("has").alias("has_a"), "v"), sizes.select("lang", F.col("source").alias("b"), F.col("base").alias("base_b"), F.col("has").alias("has_b"))
    pairs = written(a.join(b, "lang").where("a <> b"), "pairs")
    one = p.groupBy("lang", "source", "count", "p").agg(F.count("*").alias("m")).select("lang", F.col("source").alias("a"), "p", "m")
    alone = one.join(pairs.select("lang", "a", "b", "base_b"), ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.abs(F.col("p") - F.col("base_b")) * F.col("m")).alias("d"))
    base = sizes.select("lang", "source", "base")
    side = p.join(base, ["lang", "source"]).select("lang", "term", "source", "p", "base")
    x, y = (side.select("lang", "term", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "base")]) for s in "ab")
    more = F.abs(F.col("p_a") - F.col("p_b")) - F.abs(F.col("p_a") - F.col("base_b")) - F.abs(F.col("p_b") - F.col("base_a"))
    met = x.join(y, ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(more + F.abs(F.col("base_a") - F.col("base_b"))).alias("d"))
    # Each of the v terms differs by the bases unless one of the two has it; what both have was taken away twice, so it is added above.
    rest = (F.col("v") - F.col("has_a") - F.col("has_b")) * F.abs(F.col("base_a") - F.col("base_b"))
    every = pairs.select("lang", "a", "b", rest.alias("d")).union(alone).union(alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    every = every.union(met.toDF("lang", "a", "b", "d")).union(met.select("lang", F.col("source_b").alias("a"), F.col("source_a").alias("b"), "d"))
    pair = every.groupBy("lang", "a", "b").agg(F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("value")).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    term = p.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = lambda df: df.withColumn("rank", rank)
    return ranked(pair).union(ranked(term).where(F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS whole FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(whole) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT groups.lang, groups.source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY groups.lang, groups.source),
dense AS (SELECT s.lang, s.source, kept.term, coalesce(c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 5)) // (n + 5 * v) AS p,
                 1 + (CAST(1000000000 AS HUGEINT) * (whole + 5)) // (total + 5 * v) AS q
          FROM sizes s JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts ON counts.lang = s.lang AND counts.source = s.source AND counts.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS f FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
         ON z.lang = a.lang AND s = a.source AND t = b.source),
listed AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM dense WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
