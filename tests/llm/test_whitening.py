"""Whitening against exact rational moments and numpy's own decomposition."""

from collections import defaultdict
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from evalspark.llm import op12_whitening as op12


def matrix(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    q = op12._orthonormal(q.astype(np.longdouble))
    return (q * np.array(values, np.longdouble)) @ q.T, q


SPECTRA = [[5, 4, 3, 2, 1], [1.0] * 6, [3, 3, 3, 1, 1, 0], [1 + 1e-9 * i for i in range(10)] + [2 + 1e-11 * i for i in range(5)],
           np.linspace(0.1, 1, 48).tolist(), [1e6, 1e-2, 1e-2 + 1e-6, 1.0], [0.0] * 3, [7.0], []]


@pytest.mark.parametrize("values", SPECTRA, ids=range(len(SPECTRA)))
def test_eigenvectors(values):
    values = sorted(values, reverse=True)
    a, q = matrix(values) if values else (np.zeros((0, 0)), None)
    w, x = op12.eigenvectors(a)
    if not values:
        assert w.shape == (0,) and x.shape == (0, 0)
        return
    top = max(np.abs(a).max(), 1e-300)
    assert np.abs(a @ x - x * w).max() <= 1e-17 * top * len(a) and np.abs(x.T @ x - np.eye(len(a))).max() < 1e-17 * len(a)
    assert np.abs(w - np.array(values)).max() <= 1e-17 * top * len(a)
    for i, v in enumerate(values):  # beyond double precision wherever the eigenvalue stands apart
        gap = min([abs(v - u) for j, u in enumerate(values) if j != i], default=1.0)
        if gap > 1e-7 * top:
            assert abs(abs(float(q[:, i] @ x[:, i])) - 1) < 1e-15


def test_a_cluster_is_parted_by_its_sub_solve():
    """Gaps far below what float32, and steps in double, tell apart."""
    values = [1 + 4e-11, 1 + 2e-11, 1.0, 0.5 + 1e-11, 0.5]
    a, q = matrix(values, 3)
    w, x = op12.eigenvectors(a)
    assert np.abs(np.abs((q * x).sum(axis=0)) - 1).max() < 1e-14
    start = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    assert np.abs(np.abs((q * start).sum(axis=0)) - 1).max() > 1e-3


def brute(rows, components=32):
    """Moments in exact rationals; eigenvectors by numpy."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and isfinite(c) for c in v)]
    by_length = defaultdict(list)
    for i, v in rows:
        by_length[len(v)].append((i, [floor(Fraction(64) * Fraction(c)) + 1_000_000 for c in v]))
    if not by_length:
        return {}
    some = max(by_length.items(), key=lambda kv: (len(kv[1]), kv[0]))[1]
    n, d = len(some), len(some[0][1])
    sums = [sum(x[j] for _, x in some) for j in range(d)]
    y = [[n * x[j] - sums[j] for j in range(d)] for _, x in some]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n ** 3)) for b in range(d)] for a in range(d)])
    w, v = np.linalg.eigh(cov)
    w, v = w[::-1], v[:, ::-1]
    k = min(components, int((w > np.trace(cov) * 1e-12).sum()))
    out = {}
    for (i, _), r in zip(some, y):
        white = (np.array([float(Fraction(c, n)) for c in r]) @ v[:, :k]) / np.sqrt(w[:k])
        for c in range(k):
            out.setdefault((i, c + 1), []).append((n, sum(e * e for e in r), white[c], w[c] / np.trace(cov)))
    return out


def same(got, want):
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    signs = defaultdict(float)
    for (i, c), rows in got.items():
        signs[c] += sum(r[2] for r in sorted(rows)[:1]) * sum(r[2] for r in sorted(want[i, c])[:1])
    for (i, c), rows in got.items():
        turn = 1 if signs[c] >= 0 else -1
        for g, w in zip(sorted(rows), sorted(want[i, c])):
            assert g[:2] == w[:2] and g[2] == pytest.approx(turn * w[2], abs=1e-7) and g[3] == pytest.approx(w[3], rel=1e-9)


def result(df):
    out = defaultdict(list)
    errors = set()
    for r in df.collect():
        out[r.vec_id, r.component].append((r.n, r.deviation, r.whitened, r.explained))
        errors.add(r.identity_error)
    assert len(errors) <= 1 and all(0 <= e <= 1e-9 for e in errors)
    return dict(out)


def test_table_with_every_kind_of_row(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=5) * [3, 2, 1, 0.5, 0.2]).tolist()) for i in range(300)]
    rows += [(400, None), (401, []), (402, [1.0, None, 0.0, 0.0, 0.0]), (403, [float("nan")] + [0.0] * 4), (404, [float("inf")] + [0.0] * 4),
             (405, [1.0, 2.0]), (406, [1.0] * 9), (None, [0.5] * 5), (3, rows[3][1]), (3, rows[3][1]), (407, [1e300] + [0.0] * 4), (408, [1e15] * 5)]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component string").repartition(4)
    got, want = result(op12.whiten(docs)), brute([(i, v) for i, v in rows if i not in (407,) and i != 408])
    assert {c for _, c in got} == {1, 2, 3, 4, 5}
    same(got, want)
    assert op12.whiten(docs, components=2).count() == 2 * (len(got) // 5 + 2)


def test_flat_and_empty_tables(spark):
    equal = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert op12.whiten(equal).count() == 0 and op12.whiten(equal.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(50)], "vec_id long, embedding array<float>")
    got = op12.whiten(line).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-9


def test_wide_entries_stay_exact(spark):
    rows = [(i, [float(v), 0.25 * i]) for i, v in enumerate([3_000_000_123, -2_999_999_999, 17, 1_234_567_890.75])]
    got = result(op12.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    want = brute(rows)
    fits = {k: [(n, d if d < 1 << 63 else None, w, e) for n, d, w, e in v] for k, v in want.items()}
    assert {k: v[0][1] for k, v in got.items()} == {k: v[0][1] for k, v in fits.items()}
    assert any(v[0][1] is None for v in got.values())


def test_query_on_the_driver_tables(spark):
    from evalspark.llm import queries as q

    got = result(q.QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.001"))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert got and max(c for _, c in got) == 32
    same(got, brute(rows))
