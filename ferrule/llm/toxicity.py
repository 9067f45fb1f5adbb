"""Toxicity from bags of subword embeddings.

A word is the bag of its character n-grams (2 to 5 characters, with word ends, hashed), a passage the mean of its words' vectors, and a linear softmax
over that mean gives the passage's probability; embeddings and softmax are trained together, in numpy. Misspellings that never
occurred share n-grams with words that did. A document is cut into passages of `span` words; as one insult in a long text is still an insult,
its score is that of its worst passage. In training the worst passages of a toxic document stand for it, first those of words that more of the toxic
documents have, then what the model finds, chosen anew in each round.

The training documents are dealt to folds. For each fold a model is trained on the others and scores the fold, which it has not seen: that gives its scale (mean
and deviation of the clean documents' worst passages) and the cut that is given score 0.3, where misses, counted twice, and false alarms are fewest, but above what an empty text has. The models'
mean is the score. Both layers are linear, so the mean of models is again one number for each n-gram.

The training rows are a bounded sample: at most `sample` labelled documents of each label, those with the smallest hashes of their ids, of at
most `longest` characters, one text (the least) of each doc_id. All rows are scored over their whole texts. A word's part in the difference of the two
logits is one number, which is remembered.

Defined results: a text without words gets the score of an empty bag. Rows with a null doc_id are scored, not learned from; of labels that
contradict each other 1 counts; null labels are left out. If one of the labels is missing, all scores are the share of label 1 (0 if there are
no labels). With too few labels for folds one model is trained and cut on all of them. Repeated rows stay repeated. Of equally bad passages any stands for the text: their scores are equal. A very long text is cut into
passages like any other and scored whole, by the task that has its row. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import held_out, may_learn, table

BUCKETS = 1 << 16
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def subwords(word: str) -> list[int]:
    """Hashed n-grams of a word in lower case; a very long word's are those of its whole length."""
    w = f"<{word}>"
    digest = xxhash.xxh32_intdigest
    return [digest(w[i : i + n].encode()) % BUCKETS for n in range(2, 6) for i in range(len(w) - n + 1)] or [digest(w.encode()) % BUCKETS]


class Bags:
    """Embeddings (bucket, dim) and softmax weights (dim, 2)."""

    def __init__(self, dim: int = 8, seed: int = 7):
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.1, (BUCKETS, dim))
        self.w = r.normal(0, 0.5, (dim, 2))
        self.b = np.zeros(2)

    def slopes(self) -> np.ndarray:
        """Each n-gram's part in the difference of the logits."""
        return self.e @ (self.w[:, 1] - self.w[:, 0])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def starts_of(n: int, span: int) -> np.ndarray:
    """Where passages start in a text of n words."""
    return np.append(np.arange(0, n - span, max(1, span // 2)), n - span) if n > span else np.zeros(min(n, 1), int)


def passages(sums: np.ndarray, span: int) -> np.ndarray:
    """Means of overlapping passages of `span` words (one passage if there are fewer); sums: a number for each word."""
    n = len(sums)
    if n <= span:
        return np.array([sums.mean() if n else 0.0])
    c = np.concatenate(([0.0], np.cumsum(sums)))
    starts = starts_of(n, span)
    return (c[starts + span] - c[starts]) / span


def gradients(model: Bags, batch: list[np.ndarray], y: np.ndarray, weight: np.ndarray, flat: np.ndarray, first: np.ndarray, sizes: np.ndarray):
    """Weighted cross-entropy of passages (arrays of word numbers; word i has the n-grams flat[first[i]:first[i] + sizes[i]]), and its slopes: loss, d_w, d_b, n-grams met, d_e of these."""
    words = np.concatenate(batch)
    row = np.repeat(np.arange(len(batch)), [len(x) for x in batch])
    n = sizes[words]
    g = flat[np.repeat(first[words] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
    per = np.repeat(1 / (n * np.array([len(x) for x in batch])[row]), n)  # mean over n-grams, then over words
    rows = np.repeat(row, n)
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    bag = np.add.reduceat(model.e[g] * per[:, None], starts)
    z = bag @ model.w + model.b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss = -float(weight @ np.log(p[at, y]))
    p[at, y] -= 1
    p *= weight[:, None]
    d_bag = p @ model.w.T
    touched, inverse = np.unique(g, return_inverse=True)
    parts = d_bag[rows] * per[:, None]
    return loss, bag.T @ p, p.sum(axis=0), touched, np.stack([np.bincount(inverse, x, len(touched)) for x in parts.T], axis=1)


def train(texts: list[str], labels: list[int], span: int = 2, rounds: int = 4, epochs: int = 2, rate: float = 0.02, seed: int = 7) -> Bags:
    """Adam over minibatches of passages. Positives: the worst passages of toxic documents (in the first round by their words' shares of documents); negatives: of the others, the worst and some more at random."""
    model, r = Bags(seed=seed), np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = []
    for t in texts:
        docs.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64))
    # N-grams of all words in one array: a list for each word would take most of the driver's memory.
    packed, lengths = array("i"), array("i")
    for w in vocabulary:
        own = subwords(w)
        packed.extend(own)
        lengths.append(len(own))
    sizes, flat = np.array(lengths or [1], np.int64), np.array(packed or [0], np.int32)
    del vocabulary, packed, lengths
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]

    def word_slopes() -> np.ndarray:
        return np.add.reduceat(model.slopes()[flat], first) / sizes

    # How much likelier a document has the word if it is toxic.
    having = np.zeros((2, len(sizes)))
    for d, y in zip(docs, labels):
        having[y, np.unique(d)] += 1
    of_each = [len(labels) - sum(labels), sum(labels)]
    share = [np.log((having[y] + 0.1) / (of_each[y] + 0.2)) for y in (0, 1)]
    m_e, v_e = np.zeros_like(model.e), np.zeros_like(model.e)
    m_w, v_w = np.zeros_like(model.w), np.zeros_like(model.w)
    m_b, v_b = np.zeros(2), np.zeros(2)
    step = 0
    for k in range(rounds):
        slope = share[1] - share[0] if k == 0 else word_slopes()
        chosen: list[tuple[np.ndarray, int]] = []
        for d, y in zip(docs, labels):
            if not len(d):
                continue
            starts = starts_of(len(d), span)
            s = np.max([slope[d[np.minimum(starts + j, len(d) - 1)]] for j in range(span)], axis=0) if k == 0 else passages(slope[d], span)
            order = np.argsort(-s, kind="stable")
            some = order[: max(1, 3 - k)] if y else np.unique(np.concatenate((order[:8], r.integers(0, len(starts), 12))))
            chosen += [(d[starts[i] : starts[i] + span], y) for i in some]
        ones = sum(y for _, y in chosen)
        weight = {1: 0.5 / max(1, ones), 0: 0.5 / max(1, len(chosen) - ones)}
        for _ in range(epochs):
            order = r.permutation(len(chosen))
            for a in range(0, len(order), 512):
                batch = [chosen[i] for i in order[a : a + 512]]
                y = np.array([x[1] for x in batch])
                weights = np.array([weight[int(i)] for i in y]) * len(chosen) / len(y)
                _, d_w, d_b, touched, d_e = gradients(model, [x[0] for x in batch], y, weights, flat, first, sizes)
                step += 1
                fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for x, m, v, d, at in ((model.w, m_w, v_w, d_w, ...), (model.b, m_b, v_b, d_b, ...), (model.e, m_e, v_e, d_e, touched)):
                    m[at] = 0.9 * m[at] + 0.1 * d
                    v[at] = 0.999 * v[at] + 0.001 * d * d
                    x[at] -= rate * fix * m[at] / (np.sqrt(v[at]) + 1e-8)
    return model


class Scorer:
    """Scores texts: the worst passage's probability, by the mean of some models and shifted so that what they have not seen is parted best at 0.3."""

    def __init__(self, model: Bags | None, constant: float = 0.0, span: int = 8):
        self.constant, self.span = constant, span
        self.slope = None if model is None else model.slopes().astype(np.float32)
        self.shift = 0.0 if model is None else float(model.b[1] - model.b[0])
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    @classmethod
    def mean(cls, parts: list[Scorer]) -> Scorer:
        out = cls(None, span=parts[0].span)
        out.slope, out.shift = np.mean([p.slope for p in parts], axis=0), float(np.mean([p.shift for p in parts]))
        return out

    def scaled(self, mean: float, deviation: float) -> None:
        """Logits become multiples of the deviation from the mean."""
        self.slope, self.shift = self.slope / np.float32(deviation), (self.shift - mean) / deviation
        self.forget()

    def __getstate__(self):
        return self.__dict__ | {"young": {}, "old": {}}

    def forget(self) -> None:
        """Workers outlive their tasks; where other stages follow, what they remember need not."""
        self.young, self.old = {}, {}

    def word(self, w: str) -> float:
        s = self.old.get(w)
        if s is None:
            s = float(self.slope[subwords(w)].mean())
        if len(w) <= 64:
            if len(self.young) >= 250_000:
                self.young, self.old = {}, self.young
            self.young[w] = s
        return s

    def worst(self, text: str | None) -> float:
        words = words_of(text)
        got = list(map(self.young.get, words))
        if None in got:
            got = [self.word(w) if s is None else s for w, s in zip(words, got)]
        return float(passages(np.array(got), self.span).max()) + self.shift

    def score(self, text: str | None) -> float:
        if self.slope is None:
            return self.constant
        return float(sigmoid(self.worst(text)))


def cut_of(z: np.ndarray, y: np.ndarray, miss: float = 2.0) -> float:
    """Where misses (each counts as `miss` false alarms) and false alarms are fewest: half-way between two logits."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    wrong = miss * np.concatenate(([0], np.cumsum(y == 1))) + np.concatenate((np.cumsum((y == 0)[::-1])[::-1], [0]))
    best = np.flatnonzero(wrong == wrong.min())
    i = int(best[len(best) // 2])
    return float(z[max(0, i - 1)] + z[min(len(z) - 1, i)]) / 2


def fitted(texts: list[str], labels: list[int], span: int = 2, folds: int = 3) -> Scorer:
    """The mean of a model for each fold, trained on the others; scale and cut come from the fold that it has not seen. Folds have equal shares of both labels."""
    y, fold = np.array(labels), np.zeros(len(labels), int)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % folds
    z, parts = np.zeros(len(y)), []
    if min((y == 0).sum(), (y == 1).sum()) < 2 * folds:
        parts.append(Scorer(train(texts, labels, span), span=span))
        z = np.array([parts[0].worst(t) for t in texts])
    else:
        for f in range(folds):
            own, other = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            part = Scorer(train([texts[i] for i in other], [labels[i] for i in other], span, seed=7 + f), span=span)
            raw = np.array([part.worst(texts[i]) for i in own])
            clean = raw[y[own] == 0]
            mean, deviation = float(clean.mean()), max(1e-6, float(clean.std()))
            part.scaled(mean, deviation)
            z[own] = (raw - mean) / deviation
            parts.append(part)
    out = Scorer.mean(parts)
    # What no n-gram speaks for, an empty text or unknown letters, is not toxic, wherever the labels would put the cut.
    out.shift += float(np.log(0.3 / 0.7)) - max(cut_of(z, y), out.worst("") + 0.25)
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = 2000, longest: int = 8192, span: int = 2) -> Scorer:
    """docs: doc_id, text. labels: doc_id, toxic."""
    marked = labels.where(may_learn(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    # Bounded by `sample` ids a label, each of a known size, so they may be broadcast.
    ids = [marked.where(F.col("toxic") == y).orderBy(*order).limit(sample) for y in (0, 1)]
    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.char_length("text") <= longest)
    rows = some.join(F.broadcast(ids[0].union(ids[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(*order).toPandas()
    texts, y = rows["text"].tolist(), rows["toxic"].tolist()
    if len(set(y)) < 2:
        return Scorer(None, float(np.mean(y)) if y else 0.0)
    return fitted(texts, y, span)


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [sent.value.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def kept(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([sent.value.score(t.as_py()) < threshold for t in b.column(at)], pa.bool_()))
        sent.value.forget()

    return docs.mapInArrow(run, docs.schema)


def op7_subword_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
