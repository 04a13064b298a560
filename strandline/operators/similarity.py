"""Best similarity of each string of one table to any of another."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.storage import table_of

BLOCK = 2000
#: So many strings without a match yet are sent to the tasks of the right side; more meet it in a join of keys.
FEW = 1 << 18
#: Strings of the right side that a task takes together.
TOGETHER = 1 << 20


def packed(column: str, width: int, alphabet: str) -> Column:
    """A string as a number, five bits a place."""
    places = [F.instr(F.lit(alphabet), F.substring(column, i + 1, 1)).cast("long") for i in range(width)]
    known = F.length(column) == width
    code = F.lit(0).cast("long")
    for i, place in enumerate(places):
        known, code = known & (place > 0), code.bitwiseOR(F.shiftleft(place, 5 * i))
    return F.when(F.col(column).isNotNull(), F.when(known, code).otherwise(F.raise_error(F.concat(F.lit(f"not {width} symbols of {alphabet}: "), column)).cast("long")))


def most_equal(left: DataFrame, right: DataFrame, column: str, width: int, alphabet: str, row: str, few: int = FEW) -> DataFrame:
    """``row`` and ``best``: the greatest share of equal places, without comparing pairs.

    A string has m equal places with some string of the right side if their texts agree on some
    choice of m places. From all places downwards, the strings not yet matched look for such a
    text: a semi-join of keys (the places chosen and the text on them). Once at most ``few`` are
    left, these are sent to the right side's tasks instead.
    """
    spark = left.sparkSession
    rows, _ = table_of(left.select(row, packed(column, width, alphabet).alias("code")), "left")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    both, _ = table_of(right.select(packed(column, width, alphabet).alias("code")).distinct().repartition(parts, "code"), "right")
    if both.isEmpty():
        return rows.select(row, F.lit(None).cast("double").alias("best")).limit(0)
    theirs = both.where("code is not null")
    todo, _ = table_of(rows.where("code is not null").select("code").distinct(), "todo")
    chosen = F.lit(((1 << width) - 1) << 5 * width)  # a bit for each place, above the text
    found, codes = [], None
    for m in range(width, -1, -1):
        masks = [sum(31 << 5 * i | 1 << 5 * width + i for i in places) for places in combinations(range(width), m)]
        if codes is None and todo.count() <= few:
            codes = np.array([r["code"] for r in todo.collect()], np.int64)
        if codes is not None:
            if not len(codes):
                break
            hit = _sent(theirs, codes, masks)
            codes = np.setdiff1d(codes, hit)
            hits = spark.createDataFrame(pd.DataFrame({"code": hit}), "code long")
        else:
            keys = lambda df, *kept: df.select(*kept, F.explode(F.array(*[F.lit(x) for x in masks])).alias("mask"), F.col("code").alias("text")).select(*kept, F.col("text").bitwiseOR(chosen).bitwiseAND(F.col("mask")).alias("key"))
            hits, _ = table_of(keys(todo, "code").join(keys(theirs).distinct(), "key", "left_semi").select("code").distinct(), "hits")
            todo, _ = table_of(todo.join(hits, "code", "left_anti"), "todo")
        found.append(hits.withColumn("best", F.lit(m / width)))
    best = found[0] if found else todo.withColumn("best", F.lit(0.0))
    for more in found[1:]:
        best = best.union(more)
    return rows.join(best, "code", "left").groupBy(row).agg(F.max("best").alias("best"))


def _sent(theirs: DataFrame, codes: np.ndarray, masks: list[int]) -> np.ndarray:
    """Those of the codes whose masked text some row of ``theirs`` has."""
    sent = theirs.sparkSession.sparkContext.broadcast(codes)

    def look(own, rest):
        hits = []
        for mask in masks:
            texts = np.sort(own & mask)
            at = np.minimum(np.searchsorted(texts, asked := rest & mask), len(texts) - 1)
            same = texts[at] == asked
            hits.append(rest[same])
            rest = rest[~same]
        return np.concatenate(hits), rest

    def task(batches):
        rest, held, size = sent.value, [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += len(held[-1])
            if size >= TOGETHER:
                hits, rest = look(np.concatenate(held), rest)
                held, size = [], 0
                yield pa.record_batch([pa.array(hits)], ["code"])
        if size:
            yield pa.record_batch([pa.array(look(np.concatenate(held), rest)[0])], ["code"])

    hit = np.array([r["code"] for r in theirs.mapInArrow(task, "code long").distinct().collect()], np.int64)
    sent.destroy()
    return hit


def best_match(left: DataFrame, right: DataFrame, column: str, width: int, matrix: np.ndarray | None = None, alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", row: str = "row_id") -> DataFrame:
    """``row`` and ``best``: the greatest score(x, y) / sqrt(self(x) * self(y)) over all y, with the
    matrix summed place by place (identity without one: the share of equal places).

    Shares of equal places of up to 10 symbols are found by ``most_equal``. With a matrix it is a
    computed nested loop by nature. The right side is packed into blocks of strings; each block
    meets each partition of the left side once, in numpy, and maxima are merged by row.
    """
    if matrix is None and 6 * width <= 63 and len(alphabet) < 32:
        return most_equal(left, right, column, width, alphabet, row)
    index = {a: i for i, a in enumerate(alphabet)}
    table = np.eye(len(alphabet)) if matrix is None else np.asarray(matrix, float)

    def pack(batches):
        for pdf in batches:
            values = pdf[column].drop_duplicates().tolist()
            for i in range(0, len(values), BLOCK):
                yield pd.DataFrame({"block": [" ".join(values[i : i + BLOCK])]})

    packed = right.select(column).distinct().mapInPandas(pack, "block string").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(63))))
    dealt = left.select(row, column).withColumn("part", F.pmod(F.xxhash64(row), F.lit(64)).cast("int"))
    rows = dealt.groupBy("part").agg(F.collect_list(F.struct(row, column)).alias("rows"))

    def score(batches):
        for pdf in batches:
            for block, rows_here in zip(pdf["block"], pdf["rows"]):
                y = np.array([[index[a] for a in s] for s in block.split(" ")])
                own = np.sqrt(table[y, y].sum(axis=1))
                ids, best = [], []
                for r in rows_here:
                    x = np.array([index[a] for a in r[column]])
                    ids.append(r[row])
                    best.append(float((table[x[None], y].sum(axis=1) / own).max() / np.sqrt(table[x, x].sum())))
                yield pd.DataFrame({row: ids, "best": best})

    each = packed.join(rows, "part").select("block", "rows").mapInPandas(score, f"{row} long, best double")
    return each.groupBy(row).agg(F.max("best").alias("best"))
