"""Whitening against exact fractions."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import whitening

from . import fixtures

SCHEMA = "vec_id bigint, embedding array<float>"
draw = np.random.default_rng(3)
CLEAN = [(i, [float(np.float32(v)) for v in draw.normal(size=6) * (1, 0.5, 0.25, 3, 2, 1)]) for i in range(40)]
DIRTY = [
    (100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] + [0.0] * 5), (104, [float("inf")] + [0.0] * 5),
    (105, [1.0, 2.0]), (106, [0.0] * 7),
]
KEPT = CLEAN + [(7, CLEAN[7][1]), (7, CLEAN[7][1]), (None, CLEAN[8][1])]  # repeated rows, no id


def frame(spark, rows, schema=SCHEMA):
    return fixtures.with_clashes(spark.createDataFrame(rows, schema)).withColumns({"place": F.lit(0), "n": F.lit(0), "whitened": F.lit("x")}).repartition(3)


def exact(rows):
    x = [[int(np.floor(64 * np.float64(np.float32(v)))) + 1000000 for v in row] for _, row in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    c = [[Fraction(n * r[j] - s[j], n) for j in range(d)] for r in x]
    return x, n, s, [[sum(r[i] * r[j] for r in c) / n for j in range(d)] for i in range(d)]


def test_components(spark):
    got = whitening.components(frame(spark, KEPT + DIRTY)).collect()
    x, n, s, v = exact(KEPT)
    assert len(got) == len(KEPT) * 6 and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 7))
    values, vectors = whitening.eigen(np.array([[float(y) for y in r] for r in v]), 32)
    want = {}
    for (key, _), row in zip(KEPT, x, strict=True):
        c = np.array([float(Fraction(n * a - b, n)) for a, b in zip(row, s, strict=True)])
        want[key] = (sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)), c @ vectors / np.sqrt(values))
    for r in got:
        deviation, white = want[r["vec_id"]]
        assert r["deviation"] == deviation
        assert r["whitened"] == pytest.approx(white[r["component"] - 1], abs=1e-10)
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / float(sum(v[i][i] for i in range(6))), rel=1e-12)
        assert r["identity_error"] < 1e-12
    columns = {i: np.array([r["whitened"] for r in got if r["component"] == i]) for i in range(1, 7)}
    assert all(abs(np.mean(c**2) - 1) < 1e-12 and abs(c.mean()) < 1e-12 for c in columns.values())


def test_products_in_double_double(spark):
    """High and low parts hold the exact covariance to over 90 bits, over tasks as well."""
    _, n, s, v = exact(KEPT)
    high, low = whitening.products(frame(spark, KEPT).select("vec_id", F.col("embedding").cast("array<double>")), 6, lambda x: whitening.centred(x, n, s))
    for i in range(6):
        for j in range(6):
            scale = (v[i][i] * v[j][j]) * n * n
            error = Fraction(high[i, j]) + Fraction(low[i, j]) - v[i][j] * n
            assert error * error < scale / 2**180


def test_blocks_and_wide_numbers(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    q = draw.integers(-(10**9), 10**9, (50, 4))
    p = whitening.Products(4)
    p.add(q.astype(float), np.zeros(q.shape))
    want = q.astype(object).T @ q.astype(object)
    assert all(int(p.high[i, j]) + int(p.low[i, j]) == want[i, j] for i in range(4) for j in range(4))
    wide = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1e12, 5.0])]
    got = whitening.whiten(frame(spark, wide)).collect()
    assert len(got) == 3 and all(r["deviation"] is None or r["deviation"] > 0 for r in got)
    assert [r["deviation"] for r in whitening.components(frame(spark, wide)).filter("vec_id = 1").collect()] == [None, None]  # over 64 bits
    x = np.array([[5 << 40, 1], [3, 2]])
    sums = [int(v) for v in whitening.exact_sums(x)]
    assert [int(v) for v in whitening.deviations(x, 2, sums).to_pylist()] == [sum((2 * int(a) - b) ** 2 for a, b in zip(r, sums, strict=True)) for r in x]


def test_nothing_left(spark):
    for rows in ([], DIRTY[:5]):
        df = whitening.components(frame(spark, rows))
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and df.count() == 0
    equal = whitening.components(frame(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(equal) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in equal)
    flat = whitening.components(frame(spark, [(i, [float(i), 1.0]) for i in range(5)])).collect()  # a dimension that does not vary
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and flat[0]["identity_error"] < 1e-12
    tied = whitening.components(frame(spark, [(1, [1.0]), (2, [2.0, 3.0])])).select("vec_id").distinct().collect()
    assert [r[0] for r in tied] == [2]  # of two lengths as common, the longest
