"""Poisson bootstraps: each row is weighted anew in each replicate.

The weight of a row in a replicate is ``poisson_draw(uniform(rep, row))`` of ``statistics``, so it
repeats exactly on any cluster and in SQL. The draws are made for many rows and replicates at
once, and only the sums of the weights of rows that are alike leave a task: one row with a
weight for each replicate, not a row a replicate.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.storage import table_of

#: Draws a task makes, about; draws worked out together.
TASK, TOGETHER = 50_000_000, 1 << 15

_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORDS = [*range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_heads(words: list, shape: tuple[int, ...]) -> np.ndarray:
    """The first eight hex digits of the MD5 of one-block messages, as numbers. ``words``: the
    16 words of the messages, each a number or an array that broadcasts to ``shape``."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    t, u = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(61):  # the last three steps change other words only
            if i < 16:
                np.bitwise_xor(c, d, out=t)
                np.bitwise_and(t, b, out=t)
                np.bitwise_xor(t, d, out=t)
            elif i < 32:
                np.bitwise_xor(b, c, out=t)
                np.bitwise_and(t, d, out=t)
                np.bitwise_xor(t, c, out=t)
            elif i < 48:
                np.bitwise_xor(b, c, out=t)
                np.bitwise_xor(t, d, out=t)
            else:
                np.invert(d, out=t)
                np.bitwise_or(t, b, out=t)
                np.bitwise_xor(t, c, out=t)
            np.add(t, a, out=t)
            np.add(t, words[_WORDS[i]] + np.uint32(_SINES[i]), out=t)
            np.left_shift(t, np.uint32(_TURNS[i]), out=u)
            np.right_shift(t, np.uint32(32 - _TURNS[i]), out=t)
            np.bitwise_or(t, u, out=t)
            np.add(t, b, out=a)
            a, b, c, d = d, a, b, c
        return (b + np.uint32(_START[0])).byteswap()


def heads_of(texts: list[bytes], reps: list[bytes]) -> np.ndarray:
    """MD5 heads of each replicate's text followed by each row's; texts, and reps, are of one length."""
    first, size = len(reps[0]), len(reps[0]) + len(texts[0])
    if size > 55 or first > 16:  # more than a block
        return np.array([[int.from_bytes(hashlib.md5(r + t).digest()[:4], "big") for r in reps] for t in texts], np.uint32).reshape(len(texts), len(reps))
    block = np.zeros((len(texts), 64), np.uint8)
    block[:, first:size] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    block[:, size], block[:, 56:58] = 128, np.frombuffer((size * 8).to_bytes(2, "little"), np.uint8)
    head = np.zeros((len(reps), 16), np.uint8)
    head[:, :first] = np.frombuffer(b"".join(reps), np.uint8).reshape(len(reps), -1)
    rows, fronts = block.view("<u4"), head.view("<u4")
    words = []
    for k in range(16):
        word = rows[:, k : k + 1] if rows[:, k].any() else np.uint32(0)
        words.append(word | fronts[None, :, k] if 4 * k < first else word)
    return md5_heads(words, (len(texts), len(reps)))


class Draws:
    """Poisson(1) weights of rows in replicates, as ``poisson_draw`` has them."""

    def __init__(self, reps: range, most: int = 12):
        cut, p, cuts = 0.0, math.exp(-1), []
        for k in range(most):
            cut += p
            cuts.append(min(math.ceil(cut * 2**32), 2**32))
            p /= k + 1
        self.cuts = np.array(cuts, np.uint64)
        starts = np.arange(1 << 16, dtype=np.uint64) << np.uint64(16)
        low, high = (np.searchsorted(self.cuts, starts + np.uint64(x), "right") for x in (0, 0xFFFF))
        self.table = np.where(low == high, low, 255).astype(np.uint8)  # 255: a cut lies within
        texts = [str(r).encode() for r in reps]
        self.n, self.by_length = len(texts), {}
        for i, text in enumerate(texts):
            self.by_length.setdefault(len(text), []).append(i)
        self.by_length = [(np.array(at), [texts[i] for i in at]) for at in self.by_length.values()]

    def weights(self, rows: list[bytes]) -> np.ndarray:
        """A row a text, a column a replicate."""
        out = np.empty((len(rows), self.n), np.uint8)
        lengths = np.array([len(r) for r in rows])
        for length in np.unique(lengths):
            where = np.flatnonzero(lengths == length)
            texts = [rows[i] for i in where]
            for at, reps in self.by_length:
                step = max(1, TOGETHER // len(reps))
                for i in range(0, len(texts), step):
                    heads = heads_of(texts[i : i + step], reps)
                    got = self.table[heads >> np.uint32(16)]
                    if (near := got == 255).any():
                        got[near] = np.searchsorted(self.cuts, heads[near].astype(np.uint64), "right")
                    out[np.ix_(where[i : i + step], at)] = got
        return out


def starts(columns: list[pa.Array]) -> np.ndarray:
    """True at the rows that differ from the row before (the first one does). Nulls are alike, NaNs too."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        if n > 1:
            same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            both = c.is_null(nan_is_null=pa.types.is_floating(c.type)).to_numpy(zero_copy_only=False)
            nulls = c.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= ~(same | (both[1:] & both[:-1] & (nulls[1:] == nulls[:-1])))
    return new


def _bytes_of(weights: np.ndarray) -> bytes:
    """In the least type that holds them all; its size follows from the length."""
    return weights.astype(np.min_scalar_type(int(weights.max(initial=0)))).tobytes()


def weights_of(data: bytes, replicates: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // replicates}").astype(np.int64)


def drawn(df: DataFrame, keys: list[str], row: str, reps: range) -> DataFrame:
    """The keys, and as ``weights`` the sums over their rows in each replicate, as a table. Rows lie in
    parts (``part``) and in them (``seq``) in the order of the keys; a key that many rows share is in
    several parts."""
    spark = df.sparkSession
    text = F.encode(F.when(F.col(row).isNull(), "").otherwise(F.concat(F.lit(":"), F.col(row).cast("string"))), "UTF-8")
    rows = df.select(*keys, text.alias("_text"))
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(max(least, rows.count() * len(reps) // TASK), *keys, "_text").sortWithinPartitions(*keys)

    def task(batches):
        draws, part, seq = Draws(reps), TaskContext.get().partitionId(), 0
        last = total = None
        ready = []

        def row_of(key, weights):
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), *key.columns, pa.array([_bytes_of(weights)], pa.binary())], ["part", "seq", *keys, "weights"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                key = batch.select(keys)
                new = np.flatnonzero(starts(key.columns))
                sums = np.add.reduceat(draws.weights([t.as_py() for t in batch.column(len(keys))]), new, axis=0, dtype=np.int64)
                for i, weights in zip(new.tolist(), sums):
                    here = key.slice(i, 1)
                    if last is not None and i == 0 and not starts([pa.concat_arrays([x, y]) for x, y in zip(last.columns, here.columns)])[1]:
                        total = total + weights
                        continue
                    if last is not None:
                        ready.append(row_of(last, total))
                        seq += 1
                    last, total = here, weights
                if ready:
                    yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                    ready.clear()
        if last is not None:
            yield row_of(last, total)

    schema = ", ".join(["part int", "seq long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema], "weights binary"])
    return table_of(rows.mapInArrow(task, schema), "draws")[0]


def _signed(batch: pa.RecordBatch, label: str, n: int):
    """Of each row: weights, label."""
    for data, y in zip(batch.column("weights").to_pylist(), batch.column(label).to_pylist()):
        yield weights_of(data, n), y


def _runs(batches, column: str, part: bool = False):
    """Batches with the rows that begin another value of the column (or another part)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(column)] + ([batch.column("part")] if part else [])
        new = starts(columns)
        new[0] = last is None or starts([pa.concat_arrays([x, y.slice(0, 1)]) for x, y in zip(last, columns)])[1]
        yield batch, new
        last = [c.slice(len(c) - 1, 1) for c in columns]


def _collected(df: DataFrame, *names: str) -> list[tuple]:
    """Rows of a part each, in order, with their numbers for each replicate."""
    return [(r["part"], *[np.frombuffer(r[x], np.float64) for x in names]) for r in sorted(df.collect(), key=lambda r: r["part"])]


def distances(df: DataFrame, value: str, group: str, row: str, reps: range) -> DataFrame:
    """rep and ks: in each replicate the greatest distance of the distributions of groups 1 and 0.

    The driver holds two numbers a part and replicate: those before each part. Then each part's
    own running sums tell its greatest distance."""
    spark, n = df.sparkSession, len(reps)
    t = drawn(df, [value, group], row, reps)

    def totals(batches):
        sums = {}
        for batch in batches:
            for part, (w, y) in zip(batch.column("part").to_pylist(), _signed(batch, group, n)):
                if y in (0, 1):
                    sums.setdefault(part, np.zeros((2, n)))[int(y)] += w
        for part, x in sums.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "sums"])

    ends = t.groupBy("part").agg(F.min(F.struct("seq", value)).alias("a"), F.max(F.struct("seq", value)).alias("z")).select("part", F.col(f"a.{value}").alias("a"), F.col(f"z.{value}").alias("z"))
    ends = ends.select("part", F.lead(F.struct("a")).over(Window.orderBy("part")).alias("next"), "z")  # a row a part
    unfinished = {r["part"] for r in ends.where("next is not null and next.a <=> z").collect()}
    before, now = {}, np.zeros((2, n))
    for part, sums in _collected(t.mapInArrow(totals, "part int, sums binary"), "sums"):
        before.setdefault(part, now)
        now = now + sums.reshape(2, n)
    last = now
    sent = spark.sparkContext.broadcast((before, last, unfinished))

    def greatest(batches):
        before, last, unfinished = sent.value
        best, sums, at = np.zeros(n), np.zeros((2, n)), None
        with np.errstate(invalid="ignore", divide="ignore"):
            gap = lambda: np.fmax(best, np.abs(sums[1] / last[1] - sums[0] / last[0]))
            for batch, new in _runs(batches, value, part=True):
                for part, begins, (w, y) in zip(batch.column("part").to_pylist(), new, _signed(batch, group, n)):
                    if begins and at is not None and (part == at or at not in unfinished):
                        best = gap()
                    if part != at:
                        at, sums = part, before.get(part, last * 0).copy()
                    if y in (0, 1):
                        sums[int(y)] += w
            if at is not None and at not in unfinished:
                best = gap()
        yield pa.record_batch([pa.array(np.arange(n) + reps[0], pa.int64()), pa.array(np.where((last > 0).all(axis=0), best, np.nan), from_pandas=True)], ["rep", "ks"])

    parts = t.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "part").sortWithinPartitions("part", "seq")
    return parts.mapInArrow(greatest, "rep long, ks double").groupBy("rep").agg(F.max("ks").alias("ks"))


def areas(df: DataFrame, scores: list[str], label: str, row: str, reps: range) -> DataFrame:
    """rep and for each score a_<score>: in each replicate the area under the ROC curve, ties one half
    (null if a class is missing). Replicates without any row are left out.

    The driver holds three numbers a part and replicate: positives, negatives and the part's own wins."""
    spark, n = df.sparkSession, len(reps)
    t = drawn(df, [*scores, label], row, reps)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    out = {}
    for score in scores:

        def wins(batches, score=score):
            both, here, won, seen = np.zeros((2, n)), np.zeros((2, n)), np.zeros(n), np.zeros(n)
            for batch, new in _runs(batches, score):
                for begins, (w, y) in zip(new, _signed(batch, label, n)):
                    if begins:
                        won += here[1] * (both[0] + here[0] / 2)
                        both, here = both + here, np.zeros((2, n))
                    seen += w
                    if y in (0, 1):
                        here[int(y)] += w
            won += here[1] * (both[0] + here[0] / 2)
            numbers = np.stack([*(both + here), won, seen])
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([numbers.tobytes()], pa.binary())], ["part", "sums"])

        ordered = t.select(score, label, "weights").repartitionByRange(parts, score).sortWithinPartitions(score)
        below, total, seen = np.zeros((2, n)), np.zeros(n), np.zeros(n)
        for _, sums in _collected(ordered.mapInArrow(wins, "part int, sums binary"), "sums"):
            negatives, positives, won, rows = sums.reshape(4, n)
            total += won + positives * below[0]
            below = below + np.stack([negatives, positives])
            seen += rows
        with np.errstate(invalid="ignore", divide="ignore"):
            out[score] = [None if not p * q else float(x / (p * q)) for x, q, p in zip(total, *below)]
    rows = [(r, *[out[s][i] for s in scores]) for i, r in enumerate(reps) if seen[i]]
    return spark.createDataFrame(rows, ", ".join(["rep long", *[f"`a_{s}` double" for s in scores]]))
