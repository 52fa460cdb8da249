"""Operator 13 against numpy's eigendecomposition of the exact covariance."""
import numpy as np
import pytest

from strata.llm.queries import QUERIES
from strata.llm.whitening import Spectrum, secular, whiten

SF = "/root/testdata/sf0.001"


def brute(vectors, components):
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(0)
    y = ((n * fit - s) / n).astype(float)
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    rows = {}
    for (i, _), v in zip(vectors, x):
        away = n * np.array(v, object) - s
        rows[i] = int((away * away).sum()), ((away / n).astype(float) @ q) / np.sqrt(e)
    return n, rows, e / np.trace(cov)


def same(out, vectors, components=16):
    n, rows, explained = brute(vectors, components)
    got = {r.vec_id: r for r in out}
    assert set(got) == set(rows) and {r.n for r in out} == {n}
    assert [got[i].deviation for i in rows] == [rows[i][0] for i in rows]
    a = np.array([got[i].whitened for i in rows])
    b = np.array([rows[i][1] for i in rows])
    sign = np.sign((a * b).sum(0))
    assert np.abs(a - b * sign).max() < 1e-8
    assert np.allclose(out[0].explained, explained, rtol=1e-9)
    assert 0 <= out[0].identity_error < 1e-9


def run(frame, **kw):
    return whiten(frame, **kw).select("row.vec_id", "n", "deviation", "whitened", "explained", "identity_error").collect()


def test_secular_roots():
    rng = np.random.default_rng(1)
    for k in (1, 2, 5, 40):
        d = np.cumsum(rng.random(k) ** 6 + 1e-9)
        z = rng.normal(size=k) * 10.0 ** rng.integers(-4, 3, k)
        roots, diff = secular(d, z * z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.allclose(roots, want, rtol=0, atol=1e-13 * want[-1] * k)
        assert np.allclose(d[:, None] - roots, diff, atol=1e-12 * want[-1])


@pytest.mark.parametrize("rank", [3, 12])
def test_rank_one_updates_and_merge(rank):
    rng = np.random.default_rng(rank)
    x = rng.integers(-50, 50, (90, rank)) @ rng.integers(-3, 4, (rank, 12))
    x[40:60] = x[:20]
    parts = [Spectrum(12) for _ in range(3)]
    for k, v in enumerate(x):
        parts[k % 3].add(v)
    for other in parts[1:]:
        parts[0].merge(other)
    s, y = parts[0], x - x.mean(0)
    assert s.n == 90 and (s.sums == x.sum(0)).all()
    assert np.abs(s.vectors.T @ s.vectors - np.eye(12)).max() < 1e-12
    assert np.abs(s.vectors * s.values @ s.vectors.T - y.T @ y).max() < 1e-11 * s.values[-1]


def test_whiten_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) @ np.diag(2.0 ** -np.arange(20.0) * 8 + 0.1)
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(200)]       # copies count once
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(37)
    same(run(frame), vectors)
    assert {len(r.whitened) for r in run(frame, components=5)} == {5}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id long, embedding array<double>, x int, row string, n long, made double"
    odd = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0, -inf]), (5, []), (6, [1.0, 2.0, 3.0])]
    good = [(10, [0.5, 1.0]), (11, [0.25, -1.0]), (None, [0.5, 1.0]), (13, [0.0, 0.0]), (13, [0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "r", 2, 0.5) for i, v in odd + good], schema)
    out = run(frame)
    assert sorted((str(r.vec_id), r.n) for r in out) == sorted((str(i), 3) for i, _ in good)
    assert whiten(frame).select("row.*").columns == frame.columns
    # a constant dimension has no component, a single vector none at all
    flat = spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0])], "vec_id long, embedding array<double>")
    assert [len(r.whitened) for r in run(flat)] == [1, 1]
    assert run(flat.limit(1)) == [] and run(flat.limit(0)) == []


def test_op13(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op13_embedding_whitening"](spark, SF).collect()
    n, rows, explained = brute(vectors, 16)
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i in rows for c in range(1, 17))
    assert all(r.n == n and r.deviation == rows[r.vec_id][0] and r.identity_error < 1e-9 for r in got)
    a, b = np.zeros((2, len(rows), 16))
    at = {i: k for k, i in enumerate(rows)}
    for r in got:
        a[at[r.vec_id], r.component - 1] = r.whitened
        b[at[r.vec_id], r.component - 1] = rows[r.vec_id][1][r.component - 1]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert np.abs(a - b * np.sign((a * b).sum(0))).max() < 1e-8
