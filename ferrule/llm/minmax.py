"""MinHash near-dedup with min-max hashing.

A text is the set of its distinct word shingles. Each random permutation of 64-bit hashes gives two values of a set's signature, the smallest
and the largest image, so half as many evaluations serve a signature of a given length; each value of two sets agrees with a chance equal to
their Jaccard similarity, and both of one permutation never hang on the same odd member, which lowers the variance. A band is the minima and
maxima of two permutations; sets that agree in a whole band are candidates. At the threshold (0.85) a pair shares one of the 32 bands but for a chance of
6e-11 (0.478 to the power of 32), and of less above it.

Candidates are confirmed on the whole sets, in numbers of shingles. A band's bucket of up to `bucket` sets gives its pairs; in a larger one each set
is compared with three leaders, and if the bucket's sets are then not all of one component, those sets go through the exact prefix join of
near_sets.py, so no link hides in a crowded bucket. Texts with equal sets count once, so copies cost nothing more.

Defined results: letters A-Z count as a-z; fewer words than a shingle are one shingle; texts without words (null, empty, blank) have an empty
set and are linked with nothing, not even with one another. Rows of one doc_id with different texts are different documents. A null doc_id is a component's id only if the whole
component has none; a row is kept if it has its component's id, so of repeated rows all are kept (or none), and rows without an id only where nothing else is. A very long text is
one set, made in parts of bounded size in the task that has its row. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import discard, sized, table, written
from ferrule.llm.components import components
from ferrule.llm.near_sets import NearSets, _bytes, _lists, bitmap, classes, common_shingles, connected, keys_of, numbered, shingle_set, texts_of

CHUNK = 1 << 13


def permutations(count: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """x -> a x + b modulo 2^64, a odd."""
    r = np.random.default_rng(seed)
    a, b = (r.integers(0, 1 << 64, count, np.uint64) for _ in range(2))
    return a | np.uint64(1), b


def signature(members: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each permutation the smallest and the largest image: (permutations, 2)."""
    out = np.stack((np.full(len(a), np.iinfo(np.uint64).max), np.zeros(len(a), np.uint64)), axis=1)
    for at in range(0, len(members), CHUNK):
        images = members[at : at + CHUNK].view(np.uint64)[None, :] * a[:, None] + b[:, None]
        np.minimum(out[:, 0], images.min(axis=1), out=out[:, 0])
        np.maximum(out[:, 1], images.max(axis=1), out=out[:, 1])
    return out


def bands(sig: np.ndarray, each: int) -> np.ndarray:
    """A hash (int64) for every `each` permutations."""
    rows = np.ascontiguousarray(sig).reshape(len(sig) // each, -1)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(rows)], np.uint64).view(np.int64)


def signed_sets(docs: DataFrame, words: int, count: int, each: int) -> DataFrame:
    """doc_id, th, key, n, bands, bits of every row; those of an empty set have no bands."""
    a, b = permutations(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = [shingle_set(_bytes(t), words) for t in x.column(1)]
            own = [bands(signature(h, a, b), each) if len(h) else np.zeros(0, np.int64) for h in sets]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(2), keys_of(sets), pa.array(map(len, sets), pa.int64()), _lists(own), _lists([bitmap(h) for h in sets])], names=["doc_id", "th", "key", "n", "bands", "bits"])

    return texts_of(docs).mapInArrow(run, "doc_id long, th long, key binary, n long, bands array<long>, bits array<long>")


def buckets(nodes: DataFrame) -> DataFrame:
    """k, sid, n, left, size of all bands that several sets share, written. (left: what may be shared; here all of it.)"""
    every = nodes.select(F.explode("bands").alias("k"), "sid", "n", F.col("n").alias("left"))
    # Counted before the shuffle, and joined, where Spark may split a bucket of a third of all sets.
    return written(every.join(every.groupBy("k").agg(F.count("*").alias("size")).where("size > 1"), "k"), "buckets")


def near_duplicates(docs: DataFrame, words: int = 3, similarity: float = 0.85, count: int = 64, each: int = 2, bucket: int = 32, rounds: int = 3) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_shingles, component_id: a row for each row of docs. count: permutations; each: of these in a band."""
    texts = texts_of(docs)
    of = written(sized(signed_sets(docs, words, count, each), docs), "signatures")
    nodes = numbered(of.where("n > 0"), "bands")
    work = NearSets(texts, nodes, words, similarity, bucket)
    shared = buckets(nodes)
    few, many = shared.where(F.col("size") <= bucket), shared.where(F.col("size") > bucket)
    fits = F.least("nu", "nv") >= F.greatest("nu", "nv") * similarity - 1e-9
    pairs = work.side(few, "u").join(work.side(few, "v"), "k").where((F.col("u") < F.col("v")) & fits).select("u", "v", "nu", "nv")
    edges = work.verified(pairs.union(work.led(many)), "bands")
    root = components(edges)
    apart = work.apart(shared, root)
    discard(shared)
    if not apart.isEmpty():
        common, rank = common_shingles(texts, words)
        now = work.again(apart.select("sid").distinct(), common, rank, "crowded")
        root = connected(work, now, common, rank, rounds, edges)
    discard(apart)
    linked = of.where("n > 0").select("doc_id", "th", "n", "key").join(classes(nodes, root), "key").select("doc_id", "th", "n", "component_id")
    return linked.union(of.where("n = 0").select("doc_id", "th", "n", "doc_id")).withColumnRenamed("n", "n_shingles")


def op12_minmax_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Exact: sets that share a member among the rarest fifteen hundredths (and one) of each are compared in full, then links are followed.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS g FROM words),
sets AS (SELECT min(r) AS s, min(doc_id) AS low, g, len(g) AS n FROM shingled WHERE len(g) > 0 GROUP BY g),
members AS (SELECT s, n, unnest(g) AS m FROM sets),
rare AS (SELECT s, n, m, row_number() OVER (PARTITION BY s ORDER BY f, m) AS nth FROM (SELECT *, count(*) OVER (PARTITION BY m) AS f FROM members)),
heads AS (SELECT s, n, m FROM rare WHERE nth <= n - (85 * n + 99) // 100 + 1),
met AS (SELECT DISTINCT a.s AS u, b.s AS v FROM heads a JOIN heads b ON a.m = b.m AND a.s < b.s AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
shared AS (SELECT u, v, a.n AS nu, b.n AS nv, len(list_intersect(a.g, b.g)) AS met FROM met JOIN sets a ON a.s = u JOIN sets b ON b.s = v),
links AS (SELECT u, v FROM shared WHERE 100 * shared.met >= 85 * (nu + nv - shared.met)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT s, s AS t FROM sets UNION SELECT reach.s, edges.v FROM reach JOIN edges ON edges.u = reach.t),
found AS (SELECT sets.g AS g, min(other.low) AS component_id FROM reach JOIN sets ON sets.s = reach.s JOIN sets other ON other.s = reach.t GROUP BY sets.g)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM shingled LEFT JOIN found USING (g)
"""
