import random

import xxhash
from pyspark.sql import functions as F

from ferrule.llm.components import components
from ferrule.llm.line_dedup import RunStore, dedup_lines
from ferrule.llm.simhash import fingerprint, links, near_duplicates, signed

LINE = "This line is longer than twenty."


def brute_lines(docs):
    """docs: (doc_id, text)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(low)
    holders = {}
    for i, (d, t) in enumerate(docs):
        for k in {key(s) for s in (t or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, []).append(-(2**63) if d is None else d)
    out = []
    for d, t in docs:
        own = -(2**63) if d is None else d
        lines = (t or "").split("\n")
        keep = [s for s in lines if len(holders.get(key(s), ())) < 3 or own == max(holders[key(s)])]
        out.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def test_lines_against_brute_force(spark, documents):
    r = random.Random(1)
    pool = [f"Line number {i} with Ä and enough text" for i in range(12)] + ["short", "", "  ", LINE, f"\t{LINE.upper()} "]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 9))) for _ in range(60)] + [None, "", "\n\n", LINE, LINE, "a\n" * 3000 + LINE, "x" * 200_000]
    ids = list(range(len(texts) - 1)) + [None]
    for batches in (1, 4):
        got = dedup_lines(documents(texts, ids, extra="drop"), batches=batches, fanout=2)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "drop", "n_lines", "n_dropped"]
        assert sorted(map(repr, ((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in got.collect()))) == sorted(map(repr, brute_lines(list(zip(ids, texts)))))


def test_lines_of_repeated_rows_and_of_no_rows(documents):
    got = dedup_lines(documents([LINE, LINE, LINE, LINE], [1, 2, 2, 2])).collect()
    assert sorted((x.doc_id, x.n_dropped) for x in got) == [(1, 1), (2, 0), (2, 0), (2, 0)]
    assert dedup_lines(documents([LINE]).where("false")).count() == 0


def test_without_the_anti_join_lines_are_lost(documents, monkeypatch):
    """The anti-join with the runs decides which document keeps a line: without it a key is in several runs."""
    texts = [LINE, f"{LINE}\nfirst", "second", LINE, f"third\n{LINE}", "fourth", LINE, "fifth"]
    docs = documents(texts)
    rows = lambda: sorted((x.doc_id, x.text) for x in dedup_lines(docs, batches=4).collect())
    want = sorted((i, t) for i, t, _, _ in brute_lines(list(enumerate(texts))))
    assert rows() == want
    monkeypatch.setattr(RunStore, "new", lambda self, own: own)
    assert rows() != want


def test_runs_hold_a_key_once(spark):
    store = RunStore(spark, fanout=2)
    batches = [[(1, 1, 90), (2, 2, 91)], [(1, 1, 80), (3, 3, 81)], [(1, 1, 70), (2, 2, 71)], [(4, 4, 60)]]
    for b in batches:
        store.add(spark.createDataFrame(b, "h1 long, h2 long, doc long"), len(b))
    assert sorted(tuple(x) for x in store.runs().collect()) == [(1, 1, 1, 90), (2, 2, 1, 91), (3, 3, 1, 81), (4, 4, 1, 60)]
    assert [len(x) for x in store.levels] == [0, 0, 1]
    assert [(x.h1, x.top, x.n) for x in store.frequent(3).collect()] == [(1, 90, 3)]


def test_line_dedup_plan_is_native(documents):
    out = dedup_lines(documents([LINE, LINE, LINE]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def naive_fingerprint(text, words=3):
    w = [x for x in text.encode().lower().split()]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_is_as_defined():
    for t in ("", " \n", "one", "One TWO", "a b c", "a b c a b c a b c d", "é É ß x y", "w " * 70_000, "a\x1cb c\x85d e"):
        assert fingerprint(t.encode()) == naive_fingerprint(t), t[:20]


def union_find(n, pairs):
    p = list(range(n))

    def find(a):
        while p[a] != a:
            a = p[a]
        return a

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        p[b] = a
    return [find(i) for i in range(n)]


def test_links_give_the_components_of_brute_force(spark):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:  # chains and a dense crowd
        for _ in range(6):
            f ^= 1 << r.randrange(64)
            f ^= 1 << r.randrange(64)
            fps.add(f)
    center = r.getrandbits(64)
    fps |= {center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)}
    fps = sorted(signed(f) for f in fps)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2]
    want = {fps[i]: fps[c] for i, c in enumerate(union_find(len(fps), pairs))}
    for bucket in (2, 8, 1000):
        found = links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket)
        assert all(((x.u ^ x.v) & (2**64 - 1)).bit_count() <= 2 for x in found.collect())
        root = {x.node: x.root for x in components(found).collect()}
        assert {f: root.get(f, f) for f in fps} == want


def test_components_of_a_long_chain_and_a_star(spark):
    e = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[1001 + i] == 1000 for i in range(200)) and len(got) == 500
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(documents):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [base, "zz " + base, base, None, "", "  ", "quite another text that shares nothing at all with it"]
    got = {x.doc_id: x.component_id for x in near_duplicates(documents(texts)).collect()}
    assert got[2] == got[0] == 0 and got[3] == got[4] == got[5] == 3 and got[6] == 6
    far = ((fingerprint(texts[0].encode()) ^ fingerprint(texts[1].encode()))).bit_count()
    assert got[1] == (0 if far <= 2 else 1)
    nulls = near_duplicates(documents(["same text here now"] * 3, [None, 5, None])).collect()
    assert {x.component_id for x in nulls} == {5}
    assert near_duplicates(documents([base]).where("false")).count() == 0
