"""Whitening against numpy in extended precision."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnsearch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, components=8):
    """Usable ids, exact deviations, projections over roots, and shares of the variance."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in good]
    n, dim = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dim)]
    deviations = [sum((n * r[j] - sums[j]) ** 2 for j in range(dim)) for r in x]
    centred = np.array([[float(n * r[j] - sums[j]) / n for j in range(dim)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    top = np.argsort(-values, kind="stable")[:components]
    return [i for i, _ in good], deviations, centred @ axes[:, top] / np.sqrt(values[top]), values[top] / values.sum()


def compare(out, rows, tolerance=1e-9):
    ids, deviations, projected, shares = plain(rows)
    got = {(r["vec_id"], r["component"]): r for r in out.collect()}
    assert len(got) == projected.size
    for j in range(projected.shape[1]):
        column = np.array([got[i, j + 1]["whitened"] for i in ids])
        sign = np.sign(column @ projected[:, j])
        assert np.abs(column - sign * projected[:, j]).max() < tolerance
        for i, deviation in zip(ids, deviations):
            row = got[i, j + 1]
            assert (row["n"], row["deviation"]) == (len(ids), deviation)
            assert abs(row["explained"] / shares[j] - 1) < 1e-9
            assert row["identity_error"] < 1e-6


def test_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 5)
    monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", 2)
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(90, 12)) @ rng.normal(size=(12, 12)) + 3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows[3] = (3, None)
    rows[5] = (5, [None] + rows[5][1][1:])
    rows[6] = (6, [float("nan")] + rows[6][1][1:])
    rows[7] = (7, [float("-inf")] + rows[7][1][1:])
    compare(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4)), rows)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    compare(whitening.whiten(table), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_odd_rows(spark):
    """Other lengths take no part, repeated rows stay, equal vectors have nothing to divide by, empty tables are empty."""
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [2.0, 2.5]), (2, [5.0]), (3, []), (4, None), (5, [0.0, 1.0])]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit("x"), "component": F.lit(7), "index": F.lit(1)})
    out = whitening.whiten(table).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (5, 1), (5, 2)]
    assert all(r["n"] == 4 for r in out)
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5)], SCHEMA)).collect()
    assert len(same) == 15 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in same)
    assert whitening.whiten(table.limit(0)).columns == ["vec_id", *[f.split()[0] for f in whitening.RESULT.split(", ")]]
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.filter("vec_id = 4")).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(2**25 * i), 1.0 + i % 2]) for i in range(20)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    _, deviations, _, _ = plain(rows)
    assert any(d >= 2**63 for d in deviations)
    for r in out:
        assert r["deviation"] == (deviations[r["vec_id"]] if deviations[r["vec_id"]] < 2**63 else None)


@pytest.mark.parametrize("dim", [1, 3])
def test_fewer_dimensions_than_components(spark, dim):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist()) for i in range(30)]
    compare(whitening.whiten(spark.createDataFrame(rows, SCHEMA)), rows)
