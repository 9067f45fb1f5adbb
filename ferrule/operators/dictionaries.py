"""Names and texts against dictionaries of any size, which are tables: joins on an index of the entries, in place of one branch of a plan for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.labels import tokens
from ferrule.plans.state import kept

SALTS = 16
#: Of the largest bitmap: a million longs.
BITS = 1 << 26


def term_index(terms: DataFrame) -> DataFrame:
    """terms: layer, term. A row per term, written as a run of words: words (their number), run, layers (sorted). Terms without a word are left out."""
    words = F.filter(F.split(F.lower("term"), "[-_]"), lambda w: w != "")
    runs = terms.where(F.col("term").isNotNull() & F.col("layer").isNotNull()).select(F.size(words).alias("words"), F.array_join(words, "_").alias("run"), "layer").where("words > 0")
    return kept(runs.groupBy("words", "run").agg(F.array_sort(F.collect_set("layer")).alias("layers")), "terms")


def _singulars(run: Column) -> Column:
    """The run as it is, and what it may be a regular plural of."""
    without = lambda end: F.when(F.endswith(run, F.lit(end)), F.left(run, F.char_length(run) - len(end)))
    return F.filter(F.array(run, without("s"), without("es")), lambda r: r.isNotNull() & (r != ""))


def name_layers(names: DataFrame, name: str, index: DataFrame) -> DataFrame:
    """A row per distinct name that isn't null: name, layers (sorted; empty if none). index: of term_index().

    The rule of functions.labels.ident_layers: a term stands in the name as a whole run of words, its last word in the singular or a regular plural. A name's runs of as many words as terms
    have are looked up by equality, so neither the plan nor the work for a name grows with the number of terms. Work for a name of n words is n runs for each number of words in use.
    """
    c = F.col
    known = names.where(c(name).isNotNull()).select(c(name).alias("_name")).distinct().withColumn("_tokens", tokens(c("_name")))
    sizes = sorted(r.words for r in index.select("words").distinct().collect())  # numbers of words in a term: a few
    if not sizes:
        return known.select(c("_name").alias(name), F.array().cast("array<string>").alias("layers"))

    def runs_of(k: int) -> Column:
        starts = F.when(F.size("_tokens") >= k, F.sequence(F.lit(1), F.size("_tokens") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("_tokens", i, k), "_"))

    runs = F.flatten(F.array(*[runs_of(k) for k in sizes]))
    looked = known.select("_name", F.explode(F.array_distinct(F.flatten(F.transform(runs, _singulars)))).alias("run"))
    hits = looked.join(_salted(index), [F.col("run") == F.col("_run"), F.pmod(F.xxhash64("_name"), F.lit(SALTS)) == F.col("_salt")]).select("_name", F.explode("layers").alias("layer"))
    layers = hits.groupBy("_name").agg(F.array_sort(F.collect_set("layer")).alias("layers"))  # as many as there are layers
    return known.select("_name").join(layers, "_name", "left").select(c("_name").alias(name), F.coalesce("layers", F.array().cast("array<string>")).alias("layers"))


def _salted(index: DataFrame) -> DataFrame:
    """Runs that a third of all names hold are met in SALTS tasks."""
    return index.select(F.col("run").alias("_run"), "layers", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))


def first_pattern(texts: DataFrame, key: str, text: str, patterns: DataFrame, gram: int = 6) -> DataFrame:
    """patterns: id, ord (distinct), anchor, regex: each match of the regex holds the anchor as it stands. A row per key whose text some pattern matches: key, id, match.

    The pattern that comes first by ord wins; match is its first match. Patterns are looked up by the first `gram` characters of their anchors among the substrings of that length of a text,
    then the whole anchor and the regex are tested. So a text meets only patterns whose anchors begin somewhere in it; all texts are read whole. Anchors shorter than `gram` raise: an index
    that can't select is none; patterns that have none stay in functions.labels.secret. Texts that are null or short have no substring and no match. Keys are distinct.

    Substrings are held against a bitmap of the index first (at most BITS bits, so a broadcast of bounded size): what is shuffled is what hits it, a few rows a text, and no
    pattern goes through the driver where there are many.
    """
    c = F.col
    index = kept(patterns.select("id", "ord", "anchor", "regex", F.left("anchor", F.lit(gram)).alias("_gram")), "patterns")
    short = index.where(c("anchor").isNull() | (F.char_length("anchor") < gram) | c("regex").isNull()).select("id").take(1)
    if short:
        raise ValueError(f"pattern {short[0].id}: its anchor has to have {gram} characters at least")
    of = texts.where(F.char_length(text) >= gram).select(c(key).alias("_key"), c(text).alias("_text"))
    # At each place what follows it: linear in the text, as positions of characters wouldn't be.
    at = F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{gram}}}))"), F.lit(1))
    grams = of.select("_key", F.explode(F.array_distinct(at)).alias("_gram"))
    known = _in_bitmap(grams, "_gram", index).withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
    wide = index.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # The text comes once for each candidate.
    candidates = known.join(wide, ["_gram", "_salt"]).select("_key", "id", "ord", "anchor", "regex")
    tested = of.join(candidates, "_key").where(F.contains("_text", "anchor")).withColumn("_match", F.regexp_substr("_text", c("regex"))).where("_match IS NOT NULL")
    best = tested.groupBy("_key").agg(F.min_by(F.struct("id", "_match"), "ord").alias("b"))
    return best.select(c("_key").alias(key), c("b.id").alias("id"), c("b._match").alias("match"))


def _in_bitmap(rows: DataFrame, name: str, index: DataFrame) -> DataFrame:
    """rows whose `name` may stand in the index's column of that name: all that do, and few others while the index has less than a tenth of BITS entries."""
    h = lambda size: F.pmod(F.xxhash64(name), F.lit(size))
    size = 1 << max(10, min(BITS.bit_length() - 1, (16 * index.count()).bit_length()))
    bit = F.expr("shiftleft(1L, CAST(_h & 63 AS INT))")
    words = index.select(h(size).alias("_h")).groupBy(F.shiftright("_h", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    met = rows.withColumn("_h", h(size)).withColumn("_word", F.shiftright("_h", 6)).join(F.broadcast(words), "_word")
    return met.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_h", "_word", "_bits")


def layers_of(rows: DataFrame, name: str, index: DataFrame, layers: str = "layers") -> DataFrame:
    """rows with the layers of their name; null names have none. Each distinct name is looked up once."""
    x, y = rows.alias("x"), name_layers(rows, name, index).select(F.col(name).alias("_of"), F.col("layers").alias("_layers")).alias("y")
    return x.join(y, F.col(f"x.{name}") == F.col("y._of"), "left").select("x.*", F.coalesce("y._layers", F.array().cast("array<string>")).alias(layers))
