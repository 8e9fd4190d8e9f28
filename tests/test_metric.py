"""Exact search for nearly parallel vectors against all pairs, and the recall of the hyperplane form."""

import numpy as np
import pytest

from tablewarden.operators import metric, similarity

SCHEMA = "row_id long, e array<float>"


def clustered(seed, n, dims, hot):
    """Vectors around a few directions, ``hot`` of them around one, and others anywhere; some repeat."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        if i < hot:
            v = centres[0] + rng.normal(size=dims) * 0.03
        elif i % 3:
            v = centres[rng.integers(12)] * rng.uniform(0.1, 9) + rng.normal(size=dims) * rng.uniform(0, 0.6)
        else:
            v = rng.normal(size=dims)
        rows.append(v.astype(np.float32))
    rows[n - 1] = rows[n // 2]
    order = rng.permutation(n)
    return [(int(i), [float(x) for x in rows[k]]) for i, k in enumerate(order)]


def plain(rows, threshold):
    unit = np.array([v for _, v in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = np.tril(unit @ unit.T >= threshold - 1e-12, -1)
    return {rows[i][0]: {rows[j][0] for j in np.flatnonzero(near[i])} for i in np.flatnonzero(near.any(axis=1))}


@pytest.mark.parametrize("side,pivots,threshold", [(4096, 512, 0.95), (37, 9, 0.95), (64, 30, 0.6)])
def test_rows_equal_all_pairs(spark, monkeypatch, side, pivots, threshold):
    monkeypatch.setattr(metric, "SIDE", side)
    monkeypatch.setattr(metric, "PIVOTS", pivots)
    rows = clustered(4, 600, 12, 200)
    want = plain(rows, threshold)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {r.row_id: int(r.expected) for r in metric.parallel_vector(df, "e", 12, threshold).collect()}
    assert set(found) == set(want)
    assert all(other in want[i] for i, other in found.items())


def test_unusable_vectors_take_no_part_and_scale_does_not_matter(spark):
    rows = [(1, [1e30, 2e30]), (2, [1e-30, 2e-30]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, [1.0]), (9, [-1.0, -2.0]), (10, [1e30, 2e30]), (11, [0.0, -0.0])]
    got = metric.parallel_vector(spark.createDataFrame(rows, SCHEMA), "e", 2, 0.95)
    assert {r.row_id for r in got.collect()} == {2, 10}
    assert metric.parallel_vector(spark.createDataFrame([], SCHEMA), "e", 2, 0.95).count() == 0


def test_hyperplane_form_finds_nine_in_ten(spark):
    rows = clustered(8, 800, 16, 100)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    exact = {r.row_id for r in metric.parallel_vector(df, "e", 16, 0.95).collect()}
    some = {r.row_id for r in similarity.semantic_duplicate(df, "e", 16, 0.95).collect()}
    assert some <= exact and len(some) >= 0.9 * len(exact)


def test_a_vector_travels_a_few_times_and_not_once_a_cell(spark, monkeypatch):
    """Vectors that point anywhere visit all cells; what the tasks get still follows the table and not table times cells."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 32)).astype(np.float32))]
    rows += [(5000 + i, [2 * x + 0.01 for x in rows[i][1]]) for i in range(30)]
    stored, cut = [], metric.cut_lineage
    monkeypatch.setattr(metric, "cut_lineage", lambda df: stored.append(cut(df)) or stored[-1])
    got = {r.row_id: int(r.expected) for r in metric.parallel_vector(spark.createDataFrame(rows, SCHEMA).repartition(4), "e", 32, 0.95).collect()}
    assert got == {5000 + i: i for i in range(30)}
    routed = next(df for df in stored if "units" in df.columns)
    assert {f.name: f.dataType.simpleString() for f in routed.schema}["payload"] == "array<float>"
    assert routed.selectExpr("sum(size(units)) AS n").first()["n"] <= metric.PIECES * len(rows)


def test_cells_make_units_of_a_side():
    assert metric._units(np.array([3, 4, 0, 5, 20, 1, 1]), 8).tolist() == [0, 0, 0, 1, 2, 3, 3]
