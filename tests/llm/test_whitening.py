"""Whitening against numpy over distinct vectors."""

import math

import numpy as np
import pytest

from barflow.llm.whitening import whiten


def brute(rows, size=16):
    """{row: (deviation, whitened without sign)}, explained, n by the definition."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in good})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    u = np.array(distinct, float)
    away = u - np.array(sums) / n
    e, basis = np.linalg.eigh(away.T @ away / n)
    e, basis = e[::-1], basis[:, ::-1]
    out = []
    for i, x in good:
        z = (np.array(x) - np.array(sums) / n) @ basis[:, :size] / np.sqrt(e[:size])
        out.append((i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), np.abs(z)))
    return out, e[:size] / e.sum(), n


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.fixture
def rows():
    rng = np.random.default_rng(3)
    base = [rng.normal(0, 3, 20).tolist() for _ in range(300)]
    hot = base[0]
    rows = [(i, base[i % 300]) for i in range(900)] + [(1000 + i, hot) for i in range(2500)]
    return rows + [(5, hot), (5, base[1]), (None, base[2]), (7000, None), (7001, [None, *hot[1:]]), (7002, [math.nan, *hot[1:]]), (7003, [math.inf, *hot[1:]]), (7004, [100.0, *hot[1:]])]


def test_whitening_equals_brute_force(spark, rows):
    got = whiten(table(spark, rows)).collect()
    want, explained, n = brute(rows)
    assert len(got) == 16 * len(want) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append((r.deviation, abs(r.whitened)))
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    wanted = {}
    for i, deviation, z in want:
        for k, v in enumerate(z):
            wanted.setdefault((i, k + 1), []).append((deviation, v))
    assert by.keys() == wanted.keys()
    for key, values in wanted.items():
        for a, b in zip(sorted(by[key]), sorted(values), strict=True):
            assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-7)


def test_signs_agree_between_rows_and_vectors_in_parts(spark, rows):
    got = [r for r in whiten(table(spark, rows)).collect() if r.vec_id is not None and 1000 <= r.vec_id < 3500]
    assert len(got) == 16 * 2500 and len({(r.component, r.whitened) for r in got}) == 16


def test_counts_as_weights(spark):
    rng = np.random.default_rng(1)
    base = [rng.integers(-50, 50, 3).astype(float).tolist() for _ in range(40)]
    rows = [(i, base[min(i, i * 7 % 40)]) for i in range(400)]
    x = np.array([np.floor(np.array(v) * 64) for _, v in rows])
    e = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    got = whiten(table(spark, rows), weights="count").collect()
    assert {r.n for r in got} == {400} and max(r.identity_error for r in got) < 1e-9
    assert {r.component: r.explained for r in got} == pytest.approx({i + 1: v / e.sum() for i, v in enumerate(e)})
    with pytest.raises(ValueError):
        whiten(table(spark, rows), weights="other")


def test_odd_tables(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, None), (2, [None])])).collect() == []
    alone = whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.component, r.deviation, r.whitened) for r in alone] == [(None, 0, None)] * 2
    assert [(r.vec_id, r.component) for r in whiten(table(spark, [(1, [])])).collect()] == [(1, None)]
    # one direction only; other lengths come once; entries at the edge of 64 bits
    mixed = whiten(table(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0]), (4, [1.0])])).collect()
    assert sorted((r.vec_id, r.component or 0) for r in mixed) == [(1, 1), (2, 1), (3, 1), (4, 0)]
    huge = whiten(table(spark, [(1, [1e300]), (2, [-1e300]), (3, [0.0])])).collect()
    assert {r.vec_id: r.deviation for r in huge} == {1: None, 2: None, 3: 0} and all(math.isfinite(r.whitened) for r in huge)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5, "a"), (2, [0.0, 1.0], 6, "b"), (3, [3.0, 1.0], 6, None)], "vec_id long, embedding array<float>, component int, x string")
    assert whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten(df).count() == 6
