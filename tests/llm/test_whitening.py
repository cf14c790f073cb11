import numpy as np
import pytest

from kelpline.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    """id, deviation and |whitened| by components of all rows, from the covariance's eigenvectors."""
    x = [(i, [int(np.floor(64 * float(np.float32(c)))) + 10**6 for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * a - s for a, s in zip(v, sums)] for v in fit], dtype=np.float64) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, v in x:
        d = [n * a - s for a, s in zip(v, sums)]
        out.append((i, sum(a * a for a in d), (np.array(d, dtype=np.float64) / n) @ u / np.sqrt(np.maximum(e, 1e-300))))
    return n, e / e.sum(), out


@pytest.mark.parametrize("dims", [3, 20])
def test_whitening_equals_eigenvectors(spark, dims):
    rng = np.random.default_rng(dims)
    mixing = rng.normal(size=(dims, dims)) * np.geomspace(4, 0.2, dims)
    rows = [(i, (rng.normal(size=dims) @ mixing.T + 3).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]  # one vector that repeats
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], f"{SCHEMA}, other string").withColumnRenamed("other", "Embedding").repartition(9)
    got = W.whiten(docs).collect()
    n, explained, want = brute(rows)
    k = min(16, dims)
    assert len(got) == len(rows) * k
    by = {(r.vec_id, r.component): r for r in got}
    signs = np.sign([by[rows[0][0], c + 1].whitened * want[0][2][c] for c in range(k)])
    for i, deviation, w in want:
        for c in range(k):
            r = by[i, c + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(r.whitened * signs[c] - w[c]) < 1e-8 and abs(r.explained - explained[c]) < 1e-10
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-8


def test_whitening_merges_lose_nothing():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(999, 7)) * 90).astype(np.int64) + W.OFFSET
    for cuts in ([500], [1, 2, 3, 900], list(range(50, 999, 50))):
        s = W.fold(W.summarised(p) for p in np.split(x, cuts))
        c = (x - W.OFFSET) - (x - W.OFFSET).mean(axis=0)
        assert s.n == 999 and s.sums == x.sum(axis=0).tolist() and np.allclose(s.scaled.T @ s.scaled, c.T @ c, rtol=1e-12)


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0]), (8, [-inf, 0.0])]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and {r.vec_id for r in got} == {1, None} and {r.n for r in got} == {2}
    first = [r for r in got if r.component == 1]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == 1.0 and r.deviation == 128 * 128 for r in first)
    assert all(r.whitened is None and r.explained == 0.0 for r in got if r.component == 2)
    one = W.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)).collect()
    assert len(one) == 6 and all(r.whitened is None and r.deviation == 0 and r.identity_error is None for r in one)
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    huge = W.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])], SCHEMA)).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id == 1} == {None}
