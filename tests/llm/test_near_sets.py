import random

import corpus_pipeline as cp
from ferrule.llm.near_sets import near_duplicates
from tests.llm.test_lines_and_simhash import union_find


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def varied(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


def test_components_against_all_pairs(spark, documents):
    r = random.Random(5)
    text = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    texts = []
    for _ in range(25):  # about the threshold, on both sides
        base = text(r.randint(30, 200))
        texts += [" ".join(base), *(varied(r, base, e) for e in (1, 2, 3, 4, 6, 8))]
    crowd, passage = text(150), text(90)
    texts += [varied(r, crowd, r.randint(0, 3)) for _ in range(70)]  # near copies, more than a bucket
    texts += [" ".join(passage + text(r.randint(5, 30))) for _ in range(60)]  # mostly one passage
    texts += [None, "", " ", "one two", "One  TWO", "a b c d e", "a b c d e f"]
    sets = [shingles(t) for t in texts]
    roots = union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    assert 50 < len(set(roots)) < len(texts) - 100
    for bucket in (4, 32):
        assert {x.doc_id: x.component_id for x in near_duplicates(documents(texts), bucket=bucket).collect()} == dict(enumerate(roots))


def test_nulls_repeats_and_no_rows(documents):
    same = near_duplicates(documents(["same text here now"] * 3, [None, 5, None])).collect()
    assert len(same) == 3 and {x.component_id for x in same} == {5}
    assert {x.component_id for x in near_duplicates(documents(["a b"], [None])).collect()} == {None}
    assert near_duplicates(documents(["a"]).where("false")).count() == 0


def test_stage_drops_near_copies(spark, documents):
    """Three words changed of 200: far over 0.8 alike, and more than two bits of the fingerprint apart."""
    r = random.Random(6)
    base = [f"w{r.randrange(3000)}" for _ in range(200)]
    texts = [" ".join(base), varied(r, base, 3), varied(r, base, 3), " ".join(reversed(base))]
    assert sorted(x.doc_id for x in cp.drop_near_duplicates(spark, documents(texts), "").collect()) == [0, 3]
