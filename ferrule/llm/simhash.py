"""SimHash near-dedup: fingerprints of word shingles, linked where they share blocks and differ in few bits.

A fingerprint has 64 bits, cut into five blocks. Two fingerprints that differ in at most two bits agree on at least three of the blocks, so
they meet under one of ten keys (three blocks each). Small buckets are joined with themselves and each pair is verified. In a bucket of over
`bucket` different fingerprints, all pairs would be too many; there each fingerprint is put under itself and under its 64 neighbours at one
bit, and two that meet there differ in at most two bits. Such a meeting place holds 65 fingerprints at most. Both ways are exact.

Copies share a fingerprint and count once in the join. The result is one row per document with its class: no pairs are emitted.

Defined results: texts without words (null, empty, blank) have fingerprint zero and are linked like any other. A null doc_id is never a
component's id unless its whole component has none. Repeated rows stay repeated. A very long text's fingerprint is made in parts of bounded size by the task that has its row. An empty table gives an empty result. Only doc_id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import hex64, sized, table, written
from ferrule.llm.components import components

BLOCKS = (13, 13, 13, 13, 12)
CHUNK = 1 << 15


def masks(agree: int = 3, blocks: tuple[int, ...] = BLOCKS) -> list[int]:
    """For every choice of `agree` blocks, the bits of those blocks."""
    ends = np.cumsum((0, *blocks))
    bits = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(ends, ends[1:])]
    return [sum(c) for c in combinations(bits, agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """bytes.lower() and bytes.split() know A-Z and ASCII white space alone, as asked."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    digest = xxhash.xxh64_intdigest
    n, counts = len(w) - words + 1, np.zeros(64, np.int64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    for at in range(0, n, CHUNK):
        k = min(CHUNK, n - at)
        h = np.fromiter((digest(next(shingles), seed) for _ in range(k)), np.dtype("<u8"), k)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist()))


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words, seed)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), b.column(2)], names=["doc_id", "fp", "th"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (long), th (xxhash64 of the text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("th")).mapInArrow(_fingerprints(words, seed), "doc_id long, fp long, th long")


def links(fps: DataFrame, bucket: int = 32) -> DataFrame:
    """fps: fp, distinct. u, v: edges between fingerprints of at most two differing bits; all components are connected by them."""
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks()])).alias("k", "v"))
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["k", "v"]), "buckets")
    few = shared.where(F.col("n") <= bucket)
    a, b = few.select("k", "v", F.col("fp").alias("a")), few.select("k", "v", F.col("fp").alias("b"))
    near = a.join(b, ["k", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    many = shared.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    met = many.select("fp", F.explode(flips).alias("at")).groupBy("at").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    met = met.select("u", F.explode("all").alias("v")).where("u <> v")
    return near.union(met).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, bucket: int = 32) -> DataFrame:
    """doc_id, fp, th, component_id: a row for each row of docs."""
    of = written(sized(fingerprints(docs, words, seed), docs), "fingerprints")
    nodes = written(of.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    root = components(links(nodes.select("fp"), bucket))
    linked = written(root.select(F.col("node").alias("fp"), "root").union(root.select(F.col("root").alias("fp"), "root").distinct()), "linked")
    lows = written(linked.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component_id")), "lows")
    own = linked.join(lows, "root").select("fp", "component_id")
    of_fp = written(nodes.join(own, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return of.join(of_fp, "fp").select("doc_id", "fp", "th", "component_id")


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
