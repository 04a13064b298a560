"""Prepared window tensors as Parquet: rows in the order of the labelled table, read by number.

A row holds ``row_id`` (gapless from 0), the keys and labels, ``window`` (slots by dimensions),
``pad_mask`` and the pads before and after the middle. Files hold ranges of ``row_id``, so a
list of numbers skips the row groups it doesn't meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.order import numbered
from strandline.operators.tensors import pad_counts, zero_norm

BLOCK = 2048
STATUS = {0: "primary", 1: "fallback", 2: "missing", 3: "notfound"}


def write_prepared(rows: DataFrame, tensor: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, flank: int, width: int = 9) -> None:
    """The tensors of the rows that have one, in the rows' order. Only keys are numbered;
    a tensor moves twice, to its row and to its range. Keys have to be distinct in ``tensor``;
    rows without a tensor are left out (``unmatched`` lists them), null keys match nothing."""
    held = rows.join(tensor.select(*keys), list(keys), "left_semi")
    wide = numbered(held, list(order), "row_id").join(tensor, list(keys))
    pads = pad_counts("pad_mask", flank, width)
    wide = wide.withColumns({"n_pad": pads["n_pad"], "c_pad": pads["c_pad"]})
    wide.repartitionByRange("row_id").sortWithinPartitions("row_id").write.mode("overwrite").parquet(path)


def unmatched(rows: DataFrame, tensor: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a tensor."""
    return rows.join(tensor.select(*keys), list(keys), "left_anti")


def read_prepared(spark: SparkSession, path: str, numbers: Sequence[int] | DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """All rows, or those of the given numbers with the block each falls in: ``block`` numbers
    of the list make one, in increasing order. A list is pushed to the scan, a table is joined."""
    df = spark.read.parquet(path)
    if numbers is None:
        return df.withColumn("block", F.floor(F.col("row_id") / block).cast("long"))
    if not isinstance(numbers, DataFrame):
        wanted = sorted(set(numbers))
        if not wanted:
            return df.withColumn("block", F.lit(0).cast("long")).where(F.lit(False))
        df = df.where(F.col("row_id").between(wanted[0], wanted[-1]))
        numbers = spark.createDataFrame([(n,) for n in wanted], "row_id long")
    placed = numbered(numbers.select(F.col("row_id").cast("long")).where("row_id is not null").distinct(), ["row_id"], "_at")
    return df.join(placed, "row_id").withColumn("block", F.floor(F.col("_at") / block).cast("long")).drop("_at")


def alignment(rows: DataFrame, prepared: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Of all rows (no sample) those met by key, those in one table only, and for each compared
    column those whose values differ (null equals null)."""
    a = rows.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in compare], F.lit(1).alias("_in_a"))
    b = prepared.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in compare], F.lit(1).alias("_in_b"))
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    differs = [F.count_if(both & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(f"{c}_differs") for c in compare]
    joined = a.join(b, list(keys), "full")
    return joined.agg(F.count_if(both).alias("met"), F.count_if(F.col("_in_b").isNull()).alias("rows_only"), F.count_if(F.col("_in_a").isNull()).alias("tensor_only"), *differs)


def zero_vectors(df: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Number and percentage of zero vectors of each region (an array column)."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(zero_norm(r)).alias(r) for r in regions])
    return counts.select("_n", F.explode(F.create_map(*[x for r in regions for x in (F.lit(r), F.col(r))])).alias("region", "zeros")).select("region", "zeros", (100.0 * F.col("zeros") / F.nullif(F.col("_n"), F.lit(0))).alias("percent"))


def window_coverage(df: DataFrame, flank: int, status: Column | str = "status") -> DataFrame:
    """Rows by status code with its meaning, pads before and after, rows whose part before
    the middle is all padding."""
    s = F.col(status) if isinstance(status, str) else status
    meaning = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    out = df.groupBy(s.cast("int").alias("status")).agg(
        F.count("*").alias("n"),
        F.avg("n_pad").alias("n_pad_mean"),
        F.max("n_pad").alias("n_pad_max"),
        F.avg("c_pad").alias("c_pad_mean"),
        F.max("c_pad").alias("c_pad_max"),
        F.count_if(F.col("n_pad") == flank).alias("n_full"),
    )
    return out.withColumn("meaning", F.try_element_at(meaning, F.col("status")))
