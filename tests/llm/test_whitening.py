"""Whitened components against plain linear algebra, and eigenvectors that single precision cannot tell apart."""

import math
import random

import numpy as np
import pytest

from chronoweave.llm import whitening
from chronoweave.llm.queries import op13_whitening


def plain(vectors, most=4):
    """(vec_id, n, deviation, whitened values, explained) of each row kept, by float64 alone."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], float) / n
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    out = []
    for i, x in good:
        own = [n * a - s for a, s in zip(x, sums)]
        out.append((i, n, sum(v * v for v in own), np.array(own, float) / n @ axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)))
    return out


def check(got, vectors, most=4):
    want = plain(vectors, most)
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(got) == most * len(want) and {r.n for r in got} == {want[0][1]}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sign = {}
    for i, _, deviation, values, explained in want:
        for c in range(1, most + 1):
            r = rows[i, deviation][c][0]
            assert r.explained == pytest.approx(explained[c - 1], rel=1e-9)
            if abs(values[c - 1]) > 1e-6:
                assert sign.setdefault(c, math.copysign(1, r.whitened * values[c - 1])) == math.copysign(1, r.whitened * values[c - 1])
            assert abs(r.whitened) == pytest.approx(abs(values[c - 1]), rel=1e-8, abs=1e-8)


def test_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(op13_whitening(spark, "/root/testdata/sf0.01").collect(), [(r.vec_id, r.embedding) for r in table.collect()])


def test_odd_rows(spark):
    r = random.Random(1)
    vectors = [(i, [r.gauss(k, 3 - k / 3) for k in range(7)]) for i in range(200)]
    vectors += [(300 + i, vectors[7][1]) for i in range(150)] + [(None, vectors[3][1]), (5, vectors[5][1]), (400, [-0.0] * 7)]
    bad = [(500, None), (501, []), (502, [1.0] * 6 + [None]), (503, [float("nan")] * 7), (504, [float("inf")] + [0.0] * 6), (505, [1.0] * 3)]
    table = spark.createDataFrame([(i, v, 9, "a") for i, v in vectors + bad], "vec_id long, embedding array<double>, n int, whitened string").repartition(6)
    got = whitening.whitened(table).collect()
    assert {r.vec_id for r in got}.isdisjoint({500, 501, 502, 503, 504, 505})
    check(got, vectors)
    check(whitening.whitened(table, 7).collect(), vectors, 7)


def test_tables_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).collect() == []
    line = whitening.whitened(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])], schema)).collect()
    assert [(r.vec_id, r.component) for r in sorted(line)] == [(1, 1), (2, 1), (3, 1)]
    assert sorted(abs(round(r.whitened, 9)) for r in line) == [0, round(math.sqrt(1.5), 9), round(math.sqrt(1.5), 9)]


def test_large_numbers_stay_exact():
    x = np.array([[1 << 40, -3], [5, 1 << 41]], np.int64)
    sums = [int(s) for s in x.sum(0)]
    exact, y = whitening.centred(x, 1 << 30, sums)
    assert exact[0][0] == (1 << 70) - sums[0]
    assert whitening._squares(exact) == [None, None]
    assert whitening._squares(np.array([[3, 4]], np.int64)) == [25]


@pytest.mark.parametrize("gap", [2.0 ** -12, 2.0 ** -30, 2.0 ** -40])
def test_clustered_eigenvalues(gap):
    """Blocks [[c, gap], [gap, c]] have the eigenvectors (1, 1) and (1, -1); single precision sees equal eigenvalues."""
    m = 6
    a = np.zeros((2 * m + 3, 2 * m + 3))
    for b in range(m):
        a[2 * b:2 * b + 2, 2 * b:2 * b + 2] = [[3, gap * (b + 1)], [gap * (b + 1), 3]]
    a[-3:, -3:] = np.diag([9.0, 1.0, 0.5])
    p = np.random.default_rng(1).permutation(len(a))
    values, axes = whitening.eigen(a[np.ix_(p, p)])
    assert np.allclose(values, [9] + [3 + gap * b for b in range(m, 0, -1)] + [3 - gap * b for b in range(1, m + 1)] + [1, .5], rtol=0, atol=1e-15 * 9)
    back = np.empty_like(axes)
    back[p] = axes
    for k in range(1, 2 * m + 1):
        b = (m - k if k <= m else k - m - 1) * 2
        assert np.abs(np.abs(back[b:b + 2, k]) - math.sqrt(.5)).max() < 1e-15
        assert np.abs(np.delete(back[:, k], [b, b + 1])).max() < 1e-15
    assert np.abs(axes.T @ axes - np.eye(len(a))).max() < 1e-15


def test_equal_and_random_eigenvalues():
    r = np.random.default_rng(3)
    for a in (np.eye(5), np.zeros((4, 4)), np.ones((30, 30)), (lambda q: q @ np.diag(np.repeat([5., 2., 1.], [3, 20, 41])) @ q.T)(np.linalg.qr(r.normal(size=(64, 64)))[0])):
        values, axes = whitening.eigen(a)
        assert np.abs(axes.T @ axes - np.eye(len(a))).max() < 1e-14
        assert np.abs(a @ axes - axes * values).max() < 1e-13 * max(1, np.abs(a).max())
    a = r.normal(size=(100, 64))
    values, axes = whitening.eigen(a.T @ a)
    assert np.allclose(values, np.linalg.eigvalsh(a.T @ a)[::-1], rtol=1e-13)
    assert np.abs((a.T @ a) @ axes - axes * values).max() < 1e-13 * values[0]
