"""Near-duplicates by the Jaccard similarity of their sets of word shingles, exact.

A text is the set of its shingles' hashes (64 bits); texts with equal sets, told apart by 128 bits, count once and get a number. Two sets of similarity s or more share a member among
the first n - ceil(s n) + 1 of each in any order that all follow (the prefix filter), so only these are put into lists. The order is by
hash, with shingles that are common in a sample last; the lists are then counted, and members of long ones go behind all others before any list is made. So the order
decides how long the lists get, not what is found.

Texts are near-duplicates by SimHash first (`near_duplicates`): sets whose fingerprints of 64 bits agree in three of six blocks are verified, and what these link is one component. Fingerprints of
sets at the threshold differ in ten bits or so, more than any blocks find, so the prefix join follows and finds the rest; pairs in one component it doesn't verify again.

In a list of up to `bucket` sets all pairs that can still be similar, by their sizes and by what follows the shared member, are candidates. Of
longer ones each set is first compared with three leaders of its largest and of its smallest; once what these link is known, a list whose sets are all in one component is done, so a
large group of near copies costs its size. Sets of lists that are still apart go into another round, in which the members that made these lists
come last in the order, so that they meet by rarer ones. What is apart after `rounds` rounds, sets that hold little but such members, is compared
pair by pair across components. Any order finds all similar pairs, so each of them is compared or is already in one component.

Candidates are tested on bitmaps of the sets first: each bit that one has alone is a member that the other lacks, which bounds what they share.
Those that pass are verified on the whole sets.

Defined results: letters A-Z count as a-z; a text of fewer words than a shingle is one shingle; texts without words (null, empty, blank) are
equal. A null doc_id is a component's id only if its whole component has none. Repeated rows stay repeated. A very long text is one set, made in the
task that has its row. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import discard, if_small, sized, written
from ferrule.llm.components import components
from ferrule.llm.simhash import CHUNK, masks, signed

#: Blocks of a SimHash; pairs that agree in three are candidates.
SIX = (11, 11, 11, 11, 10, 10)
#: Texts from which common shingles are learned, and how many of these are told apart.
SAMPLE, COMMON = 8192, 1 << 16


def shingle_set(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes (int64)."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.int64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(w) - words + 1)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) > words else iter([b" ".join(w)])
    return np.unique(np.fromiter((digest(s, seed) for s in shingles), np.dtype("<u8"), n).view(np.int64))


def prefix(h: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """common: sorted hashes; rank: of each, larger is later. Ties go by hash, so the order is the same for all sets."""
    if not len(h):
        return h
    n = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
    if not len(common):
        return h[:n]
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    known = common[at] == h
    return np.concatenate((h[~known], h[known][np.argsort(rank[at[known]], kind="stable")]))[:n]


def _bytes(x) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), pa.int64()))


def keys_of(sets: list[np.ndarray]) -> pa.Array:
    """128 bits for each set."""
    return pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())


def bitmap(h: np.ndarray) -> np.ndarray:
    """A bit for each member's last bits, as longs: a power of two of them, of twice to four times as many bits as there are members."""
    words = 1 << max(0, (2 * len(h) - 1).bit_length() - 6) if len(h) else 1
    bits = np.zeros(words * 64, np.uint8)
    bits[h.view(np.uint64) & np.uint64(words * 64 - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _prefixes(words: int, similarity: float, common: np.ndarray, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(_bytes(x), words) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), keys_of(sets), pa.array(map(len, sets), pa.int64()), _lists([prefix(h, common, rank, similarity) for h in sets]), _lists([bitmap(h) for h in sets]), pa.array(map(simhash, sets), pa.int64())],
                names=["doc_id", "th", "key", "n", "prefix", "bits", "fp"],
            )

    return run


def _again(words: int, similarity: float, common: np.ndarray, rank: np.ndarray):
    """sid and text to sid, n, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(_bytes(x), words) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("sid"), pa.array(map(len, sets), pa.int64()), _lists([prefix(h, common, rank, similarity) for h in sets])], names=["sid", "n", "prefix"])

    return run


def _holding(hashes: np.ndarray):
    """sid, n, prefix to the sids of those that hold one of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("prefix")
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            rows = np.unique(of[np.isin(lists.flatten().to_numpy(zero_copy_only=False), hashes)])
            yield pa.RecordBatch.from_arrays([b.column("sid").take(pa.array(rows))], names=["sid"])

    return run


def _sets(words: int):
    """sid and text, whatever stands beside them, to sid and members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("sid"), _lists([shingle_set(_bytes(x), words) for x in b.column("text")])], names=["sid", "members"])

    return run


def common_shingles(texts: DataFrame, words: int, sample: int = SAMPLE, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that stand in several texts of a sample, and their ranks. Bounded by `most`."""
    n = texts.count()
    some = texts.where(F.pmod(F.xxhash64("th"), F.lit(max(1, n // sample))) == 0).dropDuplicates(["th"]).select(F.col("th").alias("sid"), "text")
    h = some.mapInArrow(_sets(words), "sid long, members array<long>").select(F.explode("members").alias("h"))
    rows = h.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(most).collect()
    rows.sort()
    return np.array([x.h for x in rows], np.int64), np.array([x.n for x in rows], np.int64)


def lacking(a: str, b: str) -> Column:
    """How many bits of a bitmap another one of as many or fewer longs doesn't have, each a member of a that isn't in b; a is folded to b's length."""
    na, nb = F.size(a), F.size(b)
    folded = F.transform(b, lambda _, i: F.aggregate(F.sequence(F.lit(0), (na / nb).cast("int") - 1), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseOR(F.get(a, j * nb + i))))
    return F.aggregate(F.zip_with(folded, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda acc, x: acc + x)


def simhash(h: np.ndarray) -> int:
    """SimHash of a set (signed): a bit is 1 if it is set in over half of the members."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        counts += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


class NearSets:
    """The rounds over one table of texts."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, words: int, similarity: float, bucket: int):
        self.texts, self.nodes, self.words, self.similarity, self.bucket = texts, nodes, words, similarity, bucket

    def bodies(self, sids: DataFrame, what: str) -> DataFrame:
        """sid, text: one text of each of these sets; a repeated row may come twice. Few are needed, so their keys go to the texts where these are not too many."""
        row = lambda d, t: F.xxhash64(d, F.isnull(d), t).alias("row")
        need = written(sids.join(self.nodes, "sid").select(row(F.col("one.doc_id"), F.col("one.th")), F.col("one.th").alias("same"), "sid"), f"{what}-need")
        return self.texts.select(row(F.col("doc_id"), F.col("th")), "th", "text").join(if_small(need), "row").where("th = same").select("sid", "text")

    def verified(self, pairs: DataFrame, what: str) -> DataFrame:
        """u, v of those of pairs (u, v, nu, nv) that are similar."""
        s = self.similarity
        pairs = written(pairs.distinct(), f"{what}-pairs")
        bits = lambda x: self.nodes.select(F.col("sid").alias(x), F.col("bits").alias(f"b{x}"))
        j = pairs.join(bits("u"), "u").join(bits("v"), "v")
        # Sizes that can be similar differ by a quarter at most, so bitmaps by a factor of two.
        longer = F.size("bu") >= F.size("bv")
        both = F.when(longer, F.col("nu") - lacking("bu", "bv")).otherwise(F.col("nv") - lacking("bv", "bu"))
        passed = written(j.where(both >= (F.col("nu") + F.col("nv")) * (s / (1 + s)) - 1e-9).select("u", "v", "nu", "nv"), f"{what}-passed")
        need = passed.select(F.col("u").alias("sid")).union(passed.select(F.col("v").alias("sid"))).distinct()
        sets = written(self.bodies(need, what).mapInArrow(_sets(self.words), "sid long, members array<long>").groupBy("sid").agg(F.first("members").alias("members")), f"{what}-sets")
        j = passed.join(sets.select(F.col("sid").alias("u"), F.col("members").alias("mu")), "u").join(sets.select(F.col("sid").alias("v"), F.col("members").alias("mv")), "v")
        both = F.size(F.array_intersect("mu", "mv"))
        links = written(j.where(both / (F.col("nu") + F.col("nv") - both) >= s).select("u", "v"), f"{what}-links")
        discard(pairs, passed, sets)
        return links

    def again(self, sids: DataFrame, common: np.ndarray, rank: np.ndarray, what: str) -> DataFrame:
        """sid, n, prefix of these sets in this order, written."""
        made = self.bodies(sids, what).mapInArrow(_again(self.words, self.similarity, common, rank), "sid long, n long, prefix array<long>")
        return written(made.groupBy("sid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")), "again")

    def settled(self, now: DataFrame, common: np.ndarray, rank: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """sid, n, prefix in an order that has the long lists' members behind all others, and this order.

        A sample sees less of what 33 sets share the more sets there are; so lists are counted before any is made, and only sets that hold a member of a long one are read again.
        """
        sizes = now.select(F.explode("prefix").alias("k")).groupBy("k").agg(F.count("*").alias("size"))
        long = written(sizes.where(F.col("size") > self.bucket), "long")
        common, rank, moved = later(common, rank, long)
        if len(moved):
            held = written(now.select("sid", "n", "prefix").mapInArrow(_holding(moved), "sid long"), "holding")
            new = self.again(held, common, rank, "settled")
            now = now.join(if_small(held), "sid", "left_anti").select("sid", "n", "prefix").unionByName(new)
        discard(long)
        return now, common, rank

    def lists(self, nodes: DataFrame) -> DataFrame:
        """nodes: sid, n, prefix. k, sid, n, left, size, heavy: the lists of more than one set; left: members of the set from this one on, heavy: how many long lists the set is in."""
        every = nodes.select("sid", "n", F.posexplode("prefix").alias("i", "k")).select("k", "sid", "n", (F.col("n") - F.col("i")).alias("left"))
        # Counted before the shuffle, and joined: a list of a third of all sets is one row there, and one that Spark may split here.
        size = every.groupBy("k").agg(F.count("*").alias("size")).where("size > 1")
        every = every.join(size, "k")
        return written(every.withColumn("heavy", F.sum(F.when(F.col("size") > self.bucket, 1).otherwise(0)).over(Window.partitionBy("sid"))), "lists")

    def fingerprinted(self) -> DataFrame:
        """u, v, verified: links of sets whose SimHashes have three of six blocks in common, so of all pairs of at most three differing bits but in crowded blocks, where each set meets leaders."""
        keys = F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(signed(m))), F.lit(i)) for i, m in enumerate(masks(blocks=SIX))])
        every = self.nodes.select("sid", "n", F.explode(keys).alias("k")).withColumn("left", F.col("n"))
        shared = written(every.join(every.groupBy("k").agg(F.count("*").alias("size")).where("size > 1"), "k"), "fingerprints")
        few, many = shared.where(F.col("size") <= self.bucket), shared.where(F.col("size") > self.bucket)
        fits = F.least("nu", "nv") >= F.greatest("nu", "nv") * self.similarity - 1e-9
        pairs = self.side(few, "u").join(self.side(few, "v"), "k").where((F.col("u") < F.col("v")) & fits).select("u", "v", "nu", "nv")
        links = self.verified(pairs.union(self.led(many)), "simhash")
        discard(shared)
        return links

    @staticmethod
    def side(df: DataFrame, x: str, *more: str) -> DataFrame:
        return df.select("k", F.col("sid").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{c}{x}") for c in more])

    def enough(self, least: Column, nu: Column, nv: Column) -> Column:
        return least >= (nu + nv) * (self.similarity / (1 + self.similarity)) - 1e-9

    def candidates(self, lists: DataFrame) -> DataFrame:
        """u, v, nu, nv: pairs of short lists, and sets of long ones with three leaders of each."""
        few, many, col = lists.where(F.col("size") <= self.bucket), lists.where(F.col("size") > self.bucket), F.col
        fits = F.least("nu", "nv") >= F.greatest("nu", "nv") * self.similarity - 1e-9
        meet = self.enough(F.least("leftu", "leftv"), col("nu"), col("nv"))
        met = self.side(few, "u", "left", "heavy").join(self.side(few, "v", "left", "heavy"), "k").where((col("u") < col("v")) & fits)
        met = met.groupBy("u", "v", "nu", "nv", "heavyu", "heavyv").agg(F.count("*").alias("both"), F.max(meet).alias("meet")).where("meet")
        # What two sets share is what their prefixes share (at most all of the lesser number in long lists) and at most the rest of one of them.
        rest_of = lambda n: F.ceil(n * self.similarity - 1e-9) - 1
        most = col("both") + F.least("heavyu", "heavyv") + F.greatest(rest_of(col("nu")), rest_of(col("nv")))
        pairs = met.where(self.enough(most, col("nu"), col("nv"))).select("u", "v", "nu", "nv")
        return pairs.union(self.led(many))

    def led(self, many: DataFrame) -> DataFrame:
        """u, v, nu, nv: each set with three sets of its largest and of its smallest list, so at most six rows a set, however many lists of a group hold it."""
        col = F.col
        first_in = lambda i: F.struct((col("n") - col("left")) * F.lit(int(i == 0)), F.xxhash64("sid", F.lit(i)))
        leaders = many.groupBy("k").agg(*[F.min_by(F.struct("sid", "n", "left"), first_in(i)).alias(f"l{i}") for i in range(3)]).select("k", F.explode(F.array("l0", "l1", "l2")).alias("l"))
        order = F.struct("size", "k")
        own = many.groupBy("sid", "n").agg(F.max_by(F.struct("k", "left"), order).alias("a"), F.min_by(F.struct("k", "left"), order).alias("b"))
        own = own.select("sid", "n", F.explode(F.array_distinct(F.array("a", "b"))).alias("x")).select("x.k", "sid", "n", "x.left")
        led = own.join(leaders, "k").where((col("sid") != col("l.sid")) & self.enough(F.least("left", "l.left"), col("n"), col("l.n")))
        first = col("sid") < col("l.sid")
        return led.select(F.least("sid", "l.sid").alias("u"), F.greatest("sid", "l.sid").alias("v"), F.when(first, col("n")).otherwise(col("l.n")).alias("nu"), F.when(first, col("l.n")).otherwise(col("n")).alias("nv"))

    def apart(self, lists: DataFrame, root: DataFrame) -> DataFrame:
        """k, sid, n, left, root, size of long lists that are not yet in one component."""
        many = lists.where(F.col("size") > self.bucket)
        rooted = written(many.join(root, F.col("sid") == F.col("node"), "left").select("k", "sid", "n", "left", "size", F.coalesce("root", "sid").alias("root")), "rooted")
        open_ = rooted.groupBy("k").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("k")
        return written(rooted.join(open_, "k"), "apart")

    def rest(self, apart: DataFrame) -> DataFrame:
        """u, v, nu, nv: all pairs of lists, across components."""
        meet = self.enough(F.least("leftu", "leftv"), F.col("nu"), F.col("nv"))
        return self.side(apart, "u", "left", "root").join(self.side(apart, "v", "left", "root"), "k").where((F.col("u") < F.col("v")) & meet & (F.col("rootu") != F.col("rootv"))).select("u", "v", "nu", "nv")


def later(common: np.ndarray, rank: np.ndarray, keys: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order with these keys (k, size) behind all others, the largest last, and those that it moves. At most COMMON of them: the order need only be the same for all."""
    rows = keys.orderBy(F.desc("size"), "k").limit(COMMON).collect()
    own = dict(zip(common.tolist(), rank.tolist()))
    top = max(own.values(), default=0)
    own |= {x.k: top + x["size"] for x in rows}
    hashes = np.array(sorted(own), np.int64)
    return hashes, np.array([own[h] for h in hashes.tolist()], np.int64), np.array([x.k for x in rows], np.int64)


def connected(work: NearSets, now: DataFrame, common: np.ndarray, rank: np.ndarray, rounds: int, edges: DataFrame | None = None) -> DataFrame:
    """node, root: the components of the sets `now` (sid, n, prefix in the order of common and rank) by all their links, and by the edges (u, v) that are known."""
    root = None if edges is None else components(edges)
    now, common, rank = work.settled(now, common, rank)
    for r in range(rounds):
        lists = work.lists(now)
        pairs = work.candidates(lists)
        found = work.verified(pairs if root is None else across(pairs, root), f"round{r}")
        edges = found if edges is None else edges.union(found)
        root = components(edges)
        apart = work.apart(lists, root)
        discard(lists)
        if apart.isEmpty():
            break
        if r + 1 == rounds:
            more = work.verified(work.rest(apart), "rest")
            if not more.isEmpty():
                root = components(edges.union(more))
            break
        common, rank, _ = later(common, rank, apart.select("k", "size").distinct())
        now = work.again(apart.select("sid").distinct(), common, rank, f"again{r}")
    return root


def across(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """Those of the pairs (u, v, nu, nv) that are not yet in one component."""
    of = lambda x: root.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    j = pairs.distinct().join(of("u"), "u", "left").join(of("v"), "v", "left")
    return j.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v", "nu", "nv")


def numbered(of: DataFrame, *columns: str) -> DataFrame:
    """A node for each key of `of`, written: key, sid (its number), least (the smallest doc_id), one (a row that has the set), n, bits and these columns."""
    one = of.groupBy("key").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("one"), *[F.first(c).alias(c) for c in ("n", "bits", *columns)])
    return written(one.withColumn("sid", F.monotonically_increasing_id()), "nodes")


def classes(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """key, component_id of every node, written: the smallest doc_id of its component."""
    linked = written(root.select(F.col("node").alias("sid"), "root").union(root.select(F.col("root").alias("sid"), "root").distinct()), "linked")
    lows = written(linked.join(nodes, "sid").groupBy("root").agg(F.min("least").alias("component_id")), "lows")
    own = linked.join(lows, "root").select("sid", "component_id")
    of_set = written(nodes.select("key", "sid", "least").join(own, "sid", "left").select("key", F.coalesce("component_id", "least").alias("component_id")), "classes")
    discard(linked, lows, nodes)
    return of_set


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("th"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, bucket: int = 32, rounds: int = 3) -> DataFrame:
    """doc_id, th (xxhash64 of the text), component_id: a row for each row of docs."""
    texts = texts_of(docs)
    common, rank = common_shingles(texts, words)
    made = texts.mapInArrow(_prefixes(words, similarity, common, rank), "doc_id long, th long, key binary, n long, prefix array<long>, bits array<long>, fp long")
    of = written(sized(made, docs), "prefixes")
    nodes = numbered(of, "prefix", "fp")
    work = NearSets(texts, nodes, words, similarity, bucket)
    root = connected(work, nodes, common, rank, rounds, work.fingerprinted())
    return of.select("doc_id", "th", "key").join(classes(nodes, root), "key").select("doc_id", "th", "component_id")
