"""Whitening against numpy on exact whole numbers, and its edge cases."""

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tidewell.llm import queries, whitening


def _expected(vectors):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    y = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, of = np.linalg.eigh(y.T @ y / n)
    values, of = values[::-1], of[:, ::-1]
    return deviation, y @ of, values


def _check(rows, ids, vectors, most=32):
    deviation, projected, values = _expected(vectors)
    count = min(most, len(values))
    assert len(rows) == len(ids) * count
    got = {(r.vec_id, r.component): r for r in rows}
    assert {i: got[i, 1].deviation for i in ids} == dict(zip(ids, deviation))
    for k in range(count):
        column = np.array([got[i, k + 1].whitened for i in ids])
        want = projected[:, k] / np.sqrt(values[k])
        assert min(np.abs(column - want).max(), np.abs(column + want).max()) < 1e-7
        assert all(abs(got[i, k + 1].explained - values[k] / values.sum()) < 1e-9 for i in ids)
    assert all(r.n == len(ids) and r.identity_error < 1e-7 for r in rows)


def test_query_equals_numpy(spark):
    sf = "/root/testdata/sf0.001"
    known = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    _check(queries.op12_whitening(spark, sf).collect(), [i for i, _ in known], [v for _, v in known])


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    fine = [(i, [float(c) for c in rng.normal(0, 1 + i % 3, 3)]) for i in range(40)] + [(7, [0.5, -0.25, 1.0]), (None, [0.1, 0.2, 0.3])]
    odd = [(50, None), (51, [1.0, None, 0.0]), (52, [float("nan"), 0.0, 0.0]), (53, [0.0, float("-inf"), 0.0]), (54, []), (55, [1.0]), (56, [1e30, 0.0, 0.0])]
    rows = spark.createDataFrame([(i, v, 1, "x") for i, v in fine + odd], "vec_id long, embedding array<double>, component int, w string")
    made = whitening.whitening(rows).collect()
    assert len(made) == 3 * len(fine) and {r.n for r in made} == {len(fine)} and all(r.identity_error < 1e-9 for r in made)
    deviation = _expected([v for _, v in fine])[0]
    assert sorted(r.deviation for r in made if r.component == 1) == sorted(deviation)
    assert all(str(r.deviation) == r.deviation_digits for r in made)


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(i, [0.5, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    rows = whitening.whitening(same).collect()
    assert {r.whitened for r in rows if r.component == 2} == {0.0} and {r.explained for r in rows} == {1.0, 0.0} and rows[0].identity_error < 1e-9
    assert [r.whitened for r in whitening.whitening(same.limit(1)).collect()] == [0.0, 0.0]
    empty = whitening.whitening(same.where("false"))
    assert empty.collect() == [] and empty.dtypes == whitening.whitening(same).dtypes


def test_far_entries_and_large_deviations(spark):
    rng = np.random.default_rng(4)
    wide = [[float(c) for c in rng.normal(0, 2e10, 2)] for _ in range(30)]
    rows = whitening.whitening(spark.createDataFrame(list(enumerate(wide)), "vec_id long, embedding array<double>")).collect()
    deviation, projected, values = _expected(wide)
    got = {(r.vec_id, r.component): r for r in rows}
    assert [int(got[i, 1].deviation_digits) for i in range(30)] == deviation and all(r.deviation is None for r in rows)
    assert all(abs(abs(got[i, 1].whitened) - abs(projected[i, 0]) / np.sqrt(values[0])) < 1e-6 for i in range(30))


def test_one_aggregation_of_all_pairs(spark):
    sums = whitening.product_sums(["a", "b", "c"])
    assert sums == ["sum(a * a)", "sum(a * b)", "sum(a * c)", "sum(b * b)", "sum(b * c)", "sum(c * c)"]
    rows = spark.range(5).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    assert whitening.sums_of_products(rows, ["a", "b"]) == [[30, 60], [60, 120]]
