"""Prepared tensors: order, lists of numbers, odd rows."""

import pytest
from pyspark.sql import functions as F

from strandline.sources import prepared

SCHEMA = "k long, window array<array<double>>, pad_mask array<boolean>"


def written(spark, tmp_path, rows, tensors):
    path = str(tmp_path / "t")
    t = spark.createDataFrame(tensors, SCHEMA)
    r = spark.createDataFrame(rows, "k long, place int")
    prepared.write_prepared(r, t, ["k"], ["place", "k"], path, 1, 1)
    return r, t, path


def made(k, mask=(False, False, False)):
    return (k, [[float(k or 0)], [1.0], [2.0]], list(mask))


def test_rows_come_in_table_order(spark, tmp_path):
    rows = [(7, 3), (5, 1), (9, 2), (4, 0), (None, 0)]
    tensors = [made(9), made(7, (True, False, True)), made(5), made(100), made(None)]
    r, t, path = written(spark, tmp_path, rows, tensors)
    got = prepared.read_prepared(spark, path).orderBy("row_id").collect()
    assert [(x.row_id, x.k, x.n_pad, x.c_pad) for x in got] == [(0, 5, 0, 0), (1, 9, 0, 0), (2, 7, 1, 1)]
    assert sorted((x.k or 0) for x in prepared.unmatched(r, t, ["k"]).collect()) == [0, 4]
    found = prepared.alignment(r, spark.read.parquet(path), ["k"], ["place"]).first()
    assert (found.met, found.rows_only, found.tensor_only, found.place_differs) == (3, 2, 0, 0)


def test_numbers_and_blocks(spark, tmp_path):
    n = 50
    _, _, path = written(spark, tmp_path, [(i, -i) for i in range(n)], [made(i) for i in range(n)])
    wanted = [40, 3, 3, 17, 8, 99, 25]
    got = sorted((x.row_id, x.k, x.block) for x in prepared.read_prepared(spark, path, wanted, block=2).collect())
    assert got == [(3, 46, 0), (8, 41, 0), (17, 32, 1), (25, 24, 1), (40, 9, 2)]
    table = spark.createDataFrame([(x,) for x in wanted] + [(None,)], "row_id long")
    assert sorted((x.row_id, x.k, x.block) for x in prepared.read_prepared(spark, path, table, block=2).collect()) == got
    assert prepared.read_prepared(spark, path, []).collect() == []
    plan = spark.read.parquet(path).where(F.col("row_id").between(3, 40))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_id,3)" in plan


@pytest.mark.parametrize("rows,tensors", [([], []), ([(1, 1)], []), ([], [made(1)])])
def test_nothing_in_common(spark, tmp_path, rows, tensors):
    r, t, path = written(spark, tmp_path, rows, tensors)
    assert prepared.read_prepared(spark, path).count() == 0
    found = prepared.alignment(r, t.withColumn("place", F.lit(0)), ["k"], ["place"]).first()
    assert (found.met, found.rows_only, found.tensor_only) == (0, len(rows), len(tensors))
    assert prepared.zero_vectors(spark.createDataFrame([], "a array<double>"), ["a"]).first().percent is None
