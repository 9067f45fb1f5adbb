"""Language identification as inference of a mixture.

Each language is a distribution over hashed byte trigrams, counted over all texts it may learn from. A document is taken as a mixture of
languages: expectation-maximisation finds the proportions under which its trigrams are likeliest. The set of languages is chosen by penalised
likelihood: from the best single language on, the language that raises the likelihood most is added as long as the rise exceeds
`penalty` times the logarithm of the number of trigrams. The prediction is the language of the largest proportion.

Counts are summed on the executors; what reaches the driver, and each task, is one number per language and bucket. Every language is learned:
there are 65,536 buckets for up to 256 languages, and for more as many fewer (256 at least) as keep the model at 2^24 numbers.

Defined results: `und` with score 0 for a null text and a text without letters (as str.isalpha has them), and for every text if there is nothing
to learn from. Of equal proportions the language that sorts first counts. Rows with a null doc_id are predicted, not learned from. Repeated rows
stay repeated. A very long text is counted in chunks, whole. An empty table gives an empty result. Only doc_id, text and, to learn, lang are
read; lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import held_out, may_learn, table

BUCKETS = 1 << 16
NONE = "und"
_LETTER = re.compile(r"[^\W\d_]")
CHUNK = 1 << 20


def has_letter(text: str) -> bool:
    """Whether a character is a letter; the pattern also finds digits that aren't decimal."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def trigram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed byte trigrams of the text in lower case, with blanks at its ends; buckets: a power of two."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    out = np.zeros(buckets, np.int64)
    shift = np.uint32(33 - buckets.bit_length())
    for at in range(0, len(b) - 2, CHUNK):
        x = b[at : at + CHUNK + 2].astype(np.uint32)
        code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761) >> shift
        out += np.bincount(code, minlength=buckets)
    return out


def buckets_for(languages: int, most: int = 1 << 24) -> int:
    """How many buckets keep the model at `most` numbers: a power of two from 256 to 65,536."""
    return min(BUCKETS, max(256, 1 << (most // max(1, languages)).bit_length() - 1))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """docs: text, lang. All languages, and the probabilities (bucket, language)."""
    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    buckets = buckets_for(rows.select("lang").distinct().count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(1).to_pylist(), b.column(0)):
                if lang not in sums:
                    sums[lang] = np.zeros(buckets, np.int64)
                sums[lang] += trigram_counts(text.as_py(), buckets)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    counts = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # A row per language, of at most as many numbers as there are buckets.
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("all")).select("lang", F.col("all.bucket").alias("bucket"), F.col("all.n").alias("n")).toArrow()
    langs = sorted(packed.column("lang").to_pylist())
    p = np.full((buckets, max(1, len(langs))), 0.05)
    at = {x: i for i, x in enumerate(langs)}
    for lang, bucket, n in zip(packed.column("lang").to_pylist(), packed.column("bucket"), packed.column("n")):
        p[bucket.values.to_numpy(), at[lang]] += n.values.to_numpy()
    return langs, p / p.sum(axis=0)


def fit(n: np.ndarray, p: np.ndarray, start: np.ndarray, rounds: int = 25, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log-likelihood; n counts, p (bucket, language)."""
    share, total = start, n.sum()
    for _ in range(rounds):
        r = p * share
        new = (n / r.sum(axis=1)) @ r / total
        moved = np.abs(new - share).max()
        share = new
        if moved < tolerance:
            break
    return share, float(n @ np.log(p @ share))


def mixture(n: np.ndarray, p: np.ndarray, penalty: float = 3.0) -> np.ndarray:
    """Proportions of the languages, zero for those that are not in the set."""
    logs = n @ np.log(p)
    chosen = [int(logs.argmax())]
    share, best = np.ones(1), float(logs[chosen[0]])
    need, total = penalty * np.log(n.sum() + 1), n.sum()
    while len(chosen) < p.shape[1]:
        # A language helps only if the likelihood rises with its first small part.
        rise = (n / (p[:, chosen] @ share)) @ p / total
        rise[chosen] = 0
        found = None
        for j in np.flatnonzero(rise > 1):
            s, ll = fit(n, p[:, [*chosen, j]], np.append(share * 0.9, 0.1))
            if ll - best > need and (found is None or ll > found[2]):
                found = (int(j), s, ll)
        if found is None:
            break
        chosen.append(found[0])
        share, best = found[1], found[2]
    out = np.zeros(p.shape[1])
    out[chosen] = share
    return out


def shares(text: str | None, p: np.ndarray) -> np.ndarray | None:
    """A text's proportions; None without letters."""
    if text is None or not has_letter(text):
        return None
    n = trigram_counts(text, len(p))
    at = np.flatnonzero(n)
    return mixture(n[at].astype(float), p[at])


def kept(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5) -> DataFrame:
    """The rows of docs of which a language makes up at least so much, with all their columns; if no language was learned, all rows with letters."""
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model[1].astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value.astype(float)
        for b in batches:
            found = [shares(t.as_py(), p) for t in b.column(at)]
            yield b.filter(pa.array([x is not None and x.max() >= least for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, languages (map of the set's proportions)."""
    langs, p = model
    sent = docs.sparkSession.sparkContext.broadcast(p.astype(np.float32))  # 65,536 numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value.astype(float)
        for b in batches:
            pred, score, sets = [], [], []
            for text in b.column(1):
                share = shares(text.as_py(), p) if langs else None
                i = NONE if share is None else int(share.argmax())
                pred.append(NONE if share is None else langs[i])
                score.append(0.0 if share is None else float(min(1.0, share[i])))
                sets.append([] if share is None else [(langs[j], float(share[j])) for j in np.flatnonzero(share)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string,double>")


def op3_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, learn(docs.where(may_learn(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
