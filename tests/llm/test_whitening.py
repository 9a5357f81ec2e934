"""Whitening against numpy's eigenvectors and plain integers."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import whitening
from attestor.session import table

SCHEMA = "vec_id long, embedding array<double>, id string, x int, component string"


def plain(rows: list[tuple]) -> tuple[list, np.ndarray, np.ndarray, int, list[int]]:
    """(kept rows with integer vectors, eigenvalues, components, n, sums)."""
    kept = []
    for i, v, *_ in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, tuple(math.floor(256 * float(c)) for c in v)))
    size = max((len(x) for _, x in kept), default=0)
    distinct = sorted({x for _, x in kept})
    full = np.array([[*x, *[0] * (size - len(x))] for x in distinct], np.float64).reshape(-1, size)
    n = len(distinct)
    sums = [sum(x[j] if j < len(x) else 0 for x in distinct) for j in range(size)]
    centred = full - full.mean(0) if n else full
    e, v = np.linalg.eigh(centred.T @ centred / max(1, n))
    return kept, e[::-1], v[:, ::-1], n, sums


def compared(got: list, rows: list[tuple], precise: float = 1e-9) -> None:
    kept, e, v, n, sums = plain(rows)
    size = len(sums)
    k = min(4, size)
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((i, c) for i, _ in kept for c in range(1, k + 1))
    of = {}
    for i, x in kept:
        x = [*x, *[0] * (size - len(x))]
        of.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), x))
    for r in got:
        j = r["component"] - 1
        assert r["n"] == n
        same = [x for d, x in of[r["vec_id"]] if d == r["deviation"]]
        assert same
        if e[j] < 1e-9 * max(1, e[0]):
            assert r["whitened"] is None
            continue
        assert abs(r["explained"] - e[j] / e.sum()) <= 1e-9 * r["explained"]
        assert r["identity_error"] < 1e-9
        near = (np.array(same) - np.array(sums) / n) @ v[:, j] / math.sqrt(e[j])
        assert min(abs(abs(near) - abs(r["whitened"]))) <= precise * max(1, abs(r["whitened"]))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_tables(spark, sf):
    df = table(spark, f"/root/testdata/sf{sf}", "embeddings")
    compared(whitening.report(df).collect(), [tuple(r) for r in df.select("vec_id", "embedding").collect()], 1e-7)


def test_edge_rows(spark):
    """Nulls, entries that aren't finite, negative zero, repeated vectors, repeated and null ids, short and empty vectors."""
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=5) * [9, 5, 3, 1, 0.1]).tolist()) for i in range(200)]
    rows += [(1, None), (2, [1.0, None, 2.0, 0.0, 1.0]), (3, [float("nan")] * 5), (4, [float("inf"), 0, 0, 0, 0]), (5, [-0.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(6, rows[0][1])] * 150 + [(None, rows[1][1]), (None, rows[2][1]), (7, [1.0, 2.0]), (8, []), (9, [1.0, 2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "a", 1, "b") for i, v in rows], SCHEMA).repartition(5)
    compared(whitening.report(df).collect(), rows)


def test_without_variance(spark):
    df = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(3)], "vec_id long, embedding array<float>")
    rows = whitening.report(df).collect()
    assert len(rows) == 6
    assert all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in rows)
    one = spark.createDataFrame([(i, [0.5, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    rows = whitening.report(one).collect()
    assert {r["component"]: r["whitened"] is None for r in rows} == {1: False, 2: True}
    assert all(r["identity_error"] < 1e-12 for r in rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert whitening.report(df).count() == 0
    assert whitening.report(df.filter("false")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.report(df.filter("false")).count() == 0


def test_large_integers(spark):
    """Sums and distances that no long holds; a distance that doesn't fit one is null."""
    values = [[2.0**40, 1.0], [-(2.0**40), 3.0], [2.0**39, 5.0], [0.0, 7.0]]
    rows = whitening.report(spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 8 and all(r["deviation"] is None for r in rows) and all(math.isfinite(r["whitened"]) and r["identity_error"] < 1e-6 for r in rows)
    mid = whitening.Centre(3, (2**62, 2**62), 2**62)
    assert mid.deviations(np.array([[2**61, 0]])) == [None]
    assert whitening.Centre(10**6, (0, 0), 10**6).deviations(np.array([[3000, 4]])) == [10**12 * (3000**2 + 16)] == [9000016 * 10**12]


def test_many_parts_fold_into_one(spark):
    """More parts than one task combines, with blocks smaller than a vector has entries."""
    rng = np.random.default_rng(1)
    basis = rng.normal(size=(8, 8)) * np.array([100, 50, 20, 10, 1, 0.5, 0.2, 0.1])[:, None]
    rows = [(i, (rng.normal(size=8) @ basis).tolist()) for i in range(3000)]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1500).select(whitening.integers(F.col("embedding")).alias("x"))
    model = whitening.fit(x)
    _, e, v, n, sums = plain(rows)
    assert (model.centre.n, list(model.centre.sums)) == (n, sums)
    assert np.allclose(model.deviations**2, e, rtol=1e-9) and np.allclose(np.abs((model.axes * v).sum(0)), 1, atol=1e-9)


def test_jacobi_finds_small_values():
    """A column far smaller than the others keeps its relative accuracy, which eigenvalues of a covariance lose."""
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(40, 6)))
    a = q * np.array([1e9, 1e5, 1, 1, 1e-4, 1e-9])
    axes, values = whitening.jacobi(np.linalg.qr(a, mode="r"))
    assert np.allclose(values, [1e9, 1e5, 1, 1, 1e-4, 1e-9], rtol=1e-6)
    assert np.allclose(axes.T @ axes, np.eye(6), atol=1e-12)
    for shape in ((0, 3), (1, 1), (2, 5), (7, 7)):
        a = rng.normal(size=shape)
        axes, values = whitening.jacobi(a)
        assert np.allclose(axes.T @ axes, np.eye(shape[1]), atol=1e-12)
        assert np.allclose(values[: min(shape)], np.linalg.svd(a, compute_uv=False)) and np.allclose(values[min(shape) :], 0, atol=1e-12)
