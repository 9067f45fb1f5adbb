"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of at least `min_chars` code points that
stand in at least `min_docs` documents lose all their lines but those in the largest doc_id holding them.

State is a set of runs, as in a log-structured store. A run is a Parquet table sorted by the 128-bit hash of the key: how many documents of the
batch that brought the key hold it, and the largest doc_id of them. Batches are ranges of doc_id, from the largest ids down. Each batch, summed
by key, is anti-joined with the runs: keys that no run holds are new and become a run of level 0, and the document that keeps such a key's
lines is decided with that, since no later batch has a larger id. Keys that a run holds already only add to its count, in a table of additions.
`fanout` runs of one level are merged into one of the next. Because of the anti-join a key stands in one run alone, so merging needs no sums
and the lines that go are those whose key's run names a larger doc_id.

Defined results: a null or empty text is one empty line. A null doc_id counts as a document and ranks below all others. Rows that share a
doc_id count as documents of their own, and all rows with the largest doc_id keep their lines. An empty table gives an empty result. A very long
text is split and hashed like any other, in its row. Of equal lines in one document all stay or all go. Only doc_id and text are read; other
columns go through, whatever their names (but for `_ferrule_doc`, `_ferrule_th` and `_ferrule_drop`, which are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import NO_ID, new_path, sized, table, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    # Where all characters are ASCII, lower() is the same and makes no string for each character.
    ascii_only = F.octet_length(line) == F.char_length(line)
    trimmed = F.trim(line, F.lit(BLANKS))
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class RunStore:
    """Levelled sorted runs of (h1, h2, n, top), a key in one run alone, and what later batches add to the counts (h1, h2, n)."""

    SCHEMA = "h1 long, h2 long, n long, top long"

    def __init__(self, spark, fanout: int = 2, keys_per_file: int = 200_000):
        self.spark, self.fanout, self.keys_per_file, self.levels, self.additions = spark, fanout, keys_per_file, [[]], []

    def runs(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else None

    def _write(self, df: DataFrame, what: str, keys: int) -> str:
        """keys: at most so many; files, and so tasks, grow with them."""
        path = new_path(self.spark, what)
        df.coalesce(1 + keys // self.keys_per_file).sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def new(self, own: DataFrame) -> DataFrame:
        """Those keys of a batch that no run holds."""
        held = self.runs()
        return own if held is None else own.join(held.select("h1", "h2"), ["h1", "h2"], "left_anti")

    def add(self, batch: DataFrame, keys: int) -> None:
        """batch: h1, h2, doc once for each key of a document, no doc above those of earlier batches; keys: how many rows."""
        own = batch.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("top"))
        first = self.runs() is None
        if not first:
            own = self.spark.read.schema(self.SCHEMA).parquet(self._write(own, "batch", keys))
        run = self._write(self.new(own), "run-0", keys)
        if not first:
            # What the anti-join didn't keep adds to the count of the run that has it.
            rest = own.join(self.spark.read.schema(self.SCHEMA).parquet(run).select("h1", "h2"), ["h1", "h2"], "left_anti")
            self.additions.append(self._write(rest.select("h1", "h2", "n"), "additions", keys))
        self.levels[0].append(run)
        self.compact()

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(paths := self.levels[level]) >= self.fanout:
                runs = self.spark.read.schema(self.SCHEMA).parquet(*paths)
                if level + 1 == len(self.levels):
                    self.levels.append([])
                keys = runs.count()
                files = 1 + keys // self.keys_per_file
                self.levels[level + 1].append(self._write(runs.repartition(files, "h1", "h2"), f"run-{level + 1}", keys))
                self.levels[level] = []
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """h1, h2, top, n of keys that stand in at least min_docs documents."""
        runs = self.runs()
        if not self.additions:
            return runs.where(F.col("n") >= min_docs)
        more = self.spark.read.schema("h1 long, h2 long, n long").parquet(*self.additions).groupBy("h1", "h2").agg(F.sum("n").alias("more"))
        n = F.col("n") + F.coalesce("more", F.lit(0))
        return runs.join(more, ["h1", "h2"], "left").select("h1", "h2", "top", n.alias("n")).where(F.col("n") >= min_docs)


#: A key in more than a part in HEAVY of all places goes the way of a broadcast; there are fewer than HEAVY of them.
HEAVY = 10_000


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """All columns of docs, with the lines that stay as text, and n_lines, n_dropped (in the place of columns of these names): a row for each row."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = docs.select(*[F.coalesce("text", F.lit("")).alias("text") if c == "text" else docs[c] for c in own], F.coalesce(docs["doc_id"], F.lit(NO_ID)).alias("_ferrule_doc"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_ferrule_th"))
    docs = whole.select("text", F.col("_ferrule_doc").alias("doc"), F.col("_ferrule_th").alias("th"))
    keys = F.transform(F.transform(lines_of(F.col("text")), line_key), lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), i.alias("pos"))))
    hashed = docs.select("doc", "th", F.sort_array(F.filter(keys, lambda x: x.isNotNull())).alias("hs"))
    hashed = written(sized(hashed.where(F.size("hs") > 0), whole), "lines")

    # hs is sorted, so a key's first line in its document is where the key before differs.
    once = F.filter(F.col("hs"), lambda x, i: (i == 0) | (F.get(F.col("hs"), i - 1)["h1"] != x["h1"]) | (F.get(F.col("hs"), i - 1)["h2"] != x["h2"]))
    # Batches: ranges of doc_id of about equal numbers of rows, largest ids first. Equal ids lie in one batch. Their edges and one count reach the driver.
    seen = hashed.agg(F.sum(F.size("hs")).alias("n"), F.percentile_approx("doc", [i / batches for i in range(batches)], 1000).alias("edges")).first()
    edges = sorted(set((seen.edges or [])[1:]), reverse=True)
    store = RunStore(spark, fanout)
    for high, low in zip([None, *edges], [*edges, None]):
        part = hashed if high is None else hashed.where(F.col("doc") <= high)
        part = part if low is None else part.where(F.col("doc") > low)
        store.add(part.select("doc", F.explode(once).alias("x")).select("x.h1", "x.h2", "doc"), (seen.n or 0) // batches)
    hot = written(store.frequent(min_docs), "hot")

    # A line that stands everywhere would be one key of a join. Such keys are few by count, so they are broadcast; the others are joined.
    every = hashed.select("doc", "th", F.explode("hs").alias("x")).select("doc", "th", "x.h1", "x.h2", "x.pos")
    heavy = F.broadcast(hot.where(F.col("n") > (seen.n or 0) // HEAVY).select("h1", "h2", F.col("top").alias("heavy")))
    every = every.join(heavy, ["h1", "h2"], "left")
    light = every.where("heavy is null").join(hot.where(F.col("n") <= (seen.n or 0) // HEAVY).select("h1", "h2", "top"), ["h1", "h2"]).where("doc < top")
    drops = every.where("doc < heavy").select("doc", "th", "pos").union(light.select("doc", "th", "pos"))
    drops = drops.groupBy("doc", "th").agg(F.sort_array(F.collect_set("pos")).alias("drop"))

    drops = drops.select(F.col("doc").alias("_ferrule_doc"), F.col("th").alias("_ferrule_th"), F.col("drop").alias("_ferrule_drop"))
    # Positions are small beside the texts and their keys unique, so they are hashed and the texts need no sort.
    j = whole.join(drops.hint("shuffle_hash"), ["_ferrule_doc", "_ferrule_th"], "left")
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1  # without making the lines

    def kept(lines: Column) -> Column:
        """The slices between dropped positions."""
        drop, size = F.col("_ferrule_drop"), F.size("_ferrule_drop")
        before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(drop, k - 1))
        until = lambda k: F.when(k == size, F.size(lines)).otherwise(F.get(drop, k))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), size), lambda k: F.slice(lines, before(k) + 2, until(k) - before(k) - 1))), "\n")

    # Through transform() the lines are split once for each row, not for each slice.
    text = F.when(F.col("_ferrule_drop").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(lines_of(F.col("text"))), kept), F.lit(0)))
    return j.select(*[text.alias("text") if c == "text" else c for c in own], n.cast("long").alias("n_lines"), F.coalesce(F.size("_ferrule_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS doc, text FROM documents),
split AS (SELECT r, doc_id, doc, string_split(coalesce(text, ''), chr(10)) AS a FROM numbered),
lines AS (SELECT r, doc_id, doc, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
marked AS (SELECT keyed.*, coalesce(doc < top, false) AS gone FROM keyed LEFT JOIN hot USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
