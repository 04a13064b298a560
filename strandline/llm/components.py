"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import drop_table, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (columns a, b).

    Each round points every node's larger neighbours, then its smaller ones, at its least
    neighbour; the table of a round is written to shared storage. Degrees are not gathered:
    a hub is a join key of many slim rows, which adaptive execution can split.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    table, seen = None, None
    while True:
        # large star: every larger neighbour of u points at the least of u and its neighbours
        around = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = around.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = around.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u itself, points at the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "cc")
        # settled when the edges stay the same: their number and a 64-bit sum of hashes
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if table is not None:
            drop_table(table)
        now = table = after
        if mark == seen or not mark[0]:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
