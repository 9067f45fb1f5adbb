"""Whitening against numpy's own eigenvectors of the covariance, on made vectors and on a driver's table."""

import os

import numpy as np
import pytest

from ferrule.llm.whitening import block_lanczos, op11_lanczos_whitening, orthonormal, whiten

DATA = "/root/testdata/sf0.001"


def expected(vectors, k=32):
    """x, n, deviations, eigenvalues (falling), vectors, trace, all from integers."""
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    dev = [sum(int(a) ** 2 for a in row) for row in (x.astype(object) * n - s.astype(object))]
    c = (x * n - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return c, n, dev, e[::-1][:k], v[:, ::-1][:, :k], e.sum()


def hold(rows, ids, vectors, k=32, sure=1e-6):
    """rows are those of whiten() for these vectors."""
    c, n, dev, e, v, trace = expected(vectors, k)
    e = e[e > 1e-9 * e[0]]
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(ids) and all(set(g) == set(range(1, len(e) + 1)) for g in got.values())
    w = np.array([[got[i][j + 1].whitened for j in range(len(e))] for i in ids])
    want = c @ v[:, : len(e)] / np.sqrt(e)
    for j in range(len(e)):
        gap = min(abs(e[j] - e[i]) for i in range(len(e)) if i != j) / e[0] if len(e) > 1 else 1
        if gap > 1e-4:
            assert min(np.abs(w[:, j] - want[:, j]).max(), np.abs(w[:, j] + want[:, j]).max()) < sure * max(1, np.abs(want[:, j]).max())
        assert abs(got[ids[0]][j + 1].explained - e[j] / trace) < 1e-9
    assert all(got[i][1].deviation == dev[at] and got[i][1].n == n for at, i in enumerate(ids))
    own = np.abs(w.T @ w / n - np.eye(len(e))).max()
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and abs(rows[0].identity_error - own) < 1e-9 and own < 1e-9


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, x string")


@pytest.mark.parametrize("d,n,k", [(64, 300, 32), (5, 40, 32), (40, 90, 3), (1, 9, 32)])
def test_against_numpy(spark, d, n, k):
    r = np.random.default_rng(d)
    v = (r.normal(size=(n, d)) * np.linspace(3, 0.5, d)).astype(np.float32)
    hold(whiten(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)]), k).collect(), list(range(n)), v, k)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    df = op11_lanczos_whitening(spark, DATA)
    assert " ".join(f"{c}:{t}" for c, t in df.dtypes) == "vec_id:bigint component:int n:bigint deviation:bigint whitened:double explained:double identity_error:double"
    hold(df.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_rows(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(30, 4)).astype(np.float32)
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 0.0, 0.0, 0.0]), (104, [0.0, float("inf"), 0.0, 0.0])]
    rows = whiten(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)] + bad)).collect()
    hold(rows, list(range(30)), v)
    # Repeated rows count each; a null id is kept; a second length is a list of its own.
    twice = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (0, v[0].tolist())] + [(200 + i, x[:2].tolist()) for i, x in enumerate(v)]
    rows = whiten(frame(spark, twice)).collect()
    assert len(rows) == 32 * 4 + 30 * 2 and {x.n for x in rows if x.component > 2} == {32} and {x.n for x in rows if (x.vec_id or 0) >= 200} == {30}
    assert sum(x.vec_id is None for x in rows) == 4


def test_without_variance(spark):
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0 and whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    # Two dimensions that always agree: one component.
    rows = whiten(frame(spark, [(i, [i / 4, i / 4]) for i in range(9)])).collect()
    assert {x.component for x in rows} == {1} and abs(rows[0].explained - 1) < 1e-9


def test_huge_entries_do_not_fail(spark):
    rows = whiten(frame(spark, [(i, [1e30 * (i % 3), float(i)]) for i in range(12)])).collect()
    assert len(rows) >= 12 and all(np.isfinite(x.whitened) for x in rows) and any(x.deviation is None for x in rows)


def test_restarts_on_breakdown():
    # A start inside an invariant space: the identity maps each block into itself, and each eigenvalue comes more often than a block is wide.
    m = np.diag([5.0] * 11 + [2.0] * 20 + [0.0] * 9)
    e, v = block_lanczos(lambda q: m @ q, 40, 14, m.trace(), block=3)
    assert np.allclose(e, [5] * 11 + [2] * 3) and np.allclose(v.T @ v, np.eye(14), atol=1e-12) and np.allclose(m @ v, v * e, atol=1e-10)
    q, anew = orthonormal(np.ones((6, 2)), np.zeros((6, 0)), 1e-9, np.random.default_rng(1))
    assert anew == 1 and np.allclose(q.T @ q, np.eye(2))


def test_stops_before_the_whole_space():
    seen = []
    m = np.diag(np.r_[np.geomspace(1e4, 10, 12), np.linspace(1, 0.1, 388)])
    e, v = block_lanczos(lambda q: (seen.append(q.shape[1]), m @ q)[1], 400, 5, m.trace())
    assert np.allclose(e, np.diag(m)[:5], rtol=1e-12) and sum(seen) < 200 and np.abs(np.abs(v[:5]) - np.eye(5)).max() < 1e-9
