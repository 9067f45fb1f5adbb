"""Min-max near-dedup against all pairs of whole sets."""

import random
import re

import numpy as np

from ferrule.llm.minmax import bands, near_duplicates, op12_minmax_near_dedup, permutations, signature
from tests.llm.test_lines_and_simhash import union_find
from tests.llm.test_near_sets import varied

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def roots_of(texts):
    sets = [shingles(t) for t in texts]
    linked = lambda a, b: a and b and 100 * len(a & b) >= 85 * len(a | b)
    return sets, union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if linked(sets[i], sets[j])])


def test_components_against_all_pairs(spark, documents):
    r = random.Random(8)
    text = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    texts = []
    for _ in range(25):  # about the threshold, on both sides
        base = text(r.randint(30, 250))
        texts += [" ".join(base), *(varied(r, base, e) for e in (1, 2, 3, 4, 6, 8))]
    crowd, passage = text(150), text(90)
    texts += [varied(r, crowd, r.randint(0, 6)) for _ in range(80)]  # near copies, more than a bucket, not all linked
    texts += [" ".join(passage + text(r.randint(5, 30))) for _ in range(60)]  # mostly one passage
    texts += [None, "", " \t\n", "one two", "One  TWO", "one two three", "a b c d e f g h", "a b c d e f g", "B c d e f g h", "\x1fa b c d", "\x1fA b c d"]
    sets, roots = roots_of(texts)
    assert 50 < len(set(roots)) < len(texts) - 100
    for bucket in (3, 32):
        got = near_duplicates(documents(texts, extra="key"), bucket=bucket).collect()
        assert {x.doc_id: x.component_id for x in got} == dict(enumerate(roots)) and all(x.n_shingles == len(sets[x.doc_id]) for x in got)


def test_odd_rows(spark, documents, tmp_path):
    def run(texts, ids):
        documents(texts, ids).write.parquet(f"{tmp_path}/{len(list(tmp_path.iterdir()))}/documents.parquet")
        return sorted(map(tuple, op12_minmax_near_dedup(spark, f"{tmp_path}/{len(list(tmp_path.iterdir())) - 1}").collect()), key=repr)

    assert run(["same text here now"] * 3, [None, 5, None]) == [(5, 2, 5, True), (None, 2, 5, False), (None, 2, 5, False)]
    assert run(["a b", "", None, ""], [None, None, 7, 7]) == sorted([(None, 1, None, True), (None, 0, None, True), (7, 0, 7, True), (7, 0, 7, True)], key=repr)
    # A row twice, and an id with two texts: the second text has no link of its own.
    assert run(["x y z u", "x y z u", "p q r s", "p q r s"], [3, 3, 3, 4]) == [(3, 2, 3, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False)]
    assert near_duplicates(documents(["a"]).where("false")).count() == 0
    r = random.Random(1)
    long = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    assert [x[2] for x in run([" ".join(long), " ".join(long[3000:]), " ".join(long[15_000:])], [0, 1, 2])] == [0, 0, 2]


def test_signature_estimates_similarity():
    """Both values of a permutation agree with the chance of the similarity; parts of any size give the same signature."""
    r = np.random.default_rng(4)
    a, b = permutations(512)
    x = r.integers(-(2**63), 2**63 - 1, 30_000)
    one, two = signature(x[:20_000], a, b), signature(x[5_000:], a, b)
    for side in (0, 1):
        assert abs((one[:, side] == two[:, side]).mean() - 15 / 30) < 0.08
    images = x[:20_000].view(np.uint64)[None, :] * a[:, None] + b[:, None]
    assert (one == np.stack((images.min(axis=1), images.max(axis=1)), axis=1)).all()
    assert len(bands(one, 2)) == 256 and len(set(bands(one, 2).tolist())) == 256


def test_bands_find_pairs_at_the_threshold():
    """At the threshold itself, over many pairs: none is missed."""
    r = np.random.default_rng(5)
    a, b = permutations(64)
    for n in (20, 200):
        for _ in range(150):
            x = r.integers(-(2**63), 2**63 - 1, n)
            cut = int(n * 0.075)
            one, two = (bands(signature(y, a, b), 2) for y in (x[cut:], x[: n - cut]))
            assert (one == two).any()
