"""Whitening against numpy's eigenvectors of the same covariance, and its edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import whitening

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int"


def by_hand(rows, k=4):
    """n, deviations and whitened rows (up to sign) from a plain covariance."""
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
             if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in whole})
    n = len(distinct)
    total = [sum(c) for c in zip(*distinct)]
    m = np.array(distinct, dtype=float) - np.array(total) / n
    values, vectors = np.linalg.eigh(m.T @ m / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in whole:
        y = (np.array(x, dtype=float) - np.array(total) / n) @ vectors / np.sqrt(values)
        out[i] = (sum((n * a - s) ** 2 for a, s in zip(x, total)), y)
    return n, values / np.trace(m.T @ m / n), out


def test_whitening_by_hand(spark, make):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows += [(9001, None), (9002, rows[0][1][:-1] + [None]), (9003, rows[0][1][:-1] + [float("nan")]),
             (9004, rows[0][1][:-1] + [float("inf")])] + [(9100 + i, rows[3][1]) for i in range(40)]
    n, explained, want = by_hand(rows)
    got = whitening.whiten(make([(i, v, 1) for i, v in rows], VECTORS)).collect()
    assert len(got) == 4 * len(want) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    mine = {}
    for r in got:
        assert r.deviation == want[r.vec_id][0]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
        mine.setdefault(r.component, {})[r.vec_id] = r.whitened
    for c in range(1, 5):
        a, b = np.array([mine[c][i] for i in want]), np.array([want[i][1][c - 1] for i in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_covariance_does_not_depend_on_partitions(spark):
    df = whitening.whole_vectors(spark.read.parquet(f"{SF}/embeddings.parquet")).select("x").distinct()
    one, many = whitening.fit(df.coalesce(1)), whitening.fit(df.repartition(7))
    assert one.values == many.values and (one.vectors == many.vectors).all() and one.sums == many.sums


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_inertia_counts_eigenvalues(d):
    rng = np.random.default_rng(d)
    v = rng.normal(size=(d, d))
    v = v + v.T
    values = np.linalg.eigvalsh(v)
    for shift in rng.uniform(values[0] - 1, values[-1] + 1, 60):
        assert whitening.inertia(v, shift) == (values > shift).sum()


@pytest.mark.parametrize("values", [[5, 5, 5] + [1] * 9, [5, 4, 4, 4, 4, 3], [5, 0, 0, 0], [1] * 8, [5, 5 * (1 - 1e-9), 3, 3 * (1 + 1e-13), 1],
                                    [1e8, 1, 1e-3], [7]])
def test_close_and_equal_eigenvalues(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(d, d)))
    v = q @ np.diag(np.array(values, dtype=float)) @ q.T
    v = (v + v.T) / 2
    got = whitening.leading(v)
    want = [x for x in sorted(values, reverse=True) if x > 0][:4]
    assert [e for e, _ in got] == pytest.approx(want, rel=1e-9, abs=1e-9 * max(values))
    basis = np.stack([x for _, x in got], axis=1)
    assert np.abs(basis.T @ basis - np.eye(len(got))).max() < 1e-12
    assert np.abs(v @ basis - basis * [e for e, _ in got]).max() < 1e-12 * max(values)


def test_whitening_edges(spark, make):
    assert whitening.whiten(make([], VECTORS)).collect() == []
    assert whitening.whiten(make([(1, None, 1), (2, [], 1)], VECTORS)).collect() == []
    assert whitening.whiten(make([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], VECTORS)).collect() == []  # no variance
    line = whitening.whiten(make([(None, [0.0, 0.0], 1), (2, [1.0, 1.0], 1), (2, [1.0, 1.0], 1)], VECTORS)).collect()
    assert sorted(((repr(r.vec_id), r.component, r.n, r.deviation, round(abs(r.whitened), 9)) for r in line)) == [
        ("2", 1, 2, 2 * 256 ** 2, 1.0), ("2", 1, 2, 2 * 256 ** 2, 1.0), ("None", 1, 2, 2 * 256 ** 2, 1.0)]
    ragged = whitening.whiten(make([(1, [1.0], 1), (2, [0.0, 3.0], 1), (3, [2.0, 1.0], 1)], VECTORS))
    assert ragged.groupBy("component").agg(F.count("*").alias("n")).filter("n = 3").count() == 2
    huge = whitening.whiten(make([(1, [1e30], 1), (2, [-1e30], 1), (3, [0.0], 1)], VECTORS)).collect()
    assert len(huge) == 3 and huge[0].identity_error < 1e-9 and all(r.deviation is None for r in huge if r.vec_id != 3)


def test_whole_number_sums_are_exact():
    y = np.array([[1 << 40, -(1 << 40)], [3, 5]], dtype=np.int64)
    got = whitening.products(y)
    assert got[0, 0] == (1 << 80) + 9 and got[0, 1] == -(1 << 80) + 15
    limbs = whitening._limbs(np.array([(1 << 80) + 9, -(1 << 80) + 15, 7, -7], dtype=object))
    rows = [{k: v[i].as_py() for k, v in limbs.items()} for i in range(4)]
    assert [whitening._whole(r) for r in rows] == [(1 << 80) + 9, -(1 << 80) + 15, 7, -7]
