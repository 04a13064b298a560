"""Shared pieces of the training-data operators: shared storage, exact global
positions, byte-level text slices and word-shingle hashing."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandline-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new empty folder in the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)  # only what exists is noted for removal
    system.deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and a lost
    executor costs no recomputation. Shuffle files of earlier, finished jobs are released."""
    spark = df.sparkSession
    release(spark)
    path = new_path(spark, name)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._table_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove a table made by ``materialize`` that no pending plan reads."""
    remove(df.sparkSession, df._table_path)


def global_position(df: DataFrame, order: list, name: str, out: str = "position") -> DataFrame:
    """Exact 0-based rank of every row in the total order ``order``.

    One range exchange of the (slim) rows, a table of it, and the row counts of its
    partitions on the driver, as many numbers as there are partitions. No single-task window.
    """
    spark = df.sparkSession
    dealt = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    table = materialize(dealt, name)
    counts = sorted(table.groupBy("__part").count().collect())
    base, rows = 0, []
    for part, n in counts:
        rows.append((part, base))
        base += n
    bases = spark.createDataFrame(rows or [(0, 0)], "__part int, __base long")
    return (
        table.join(F.broadcast(bases), "__part")  # one row a partition
        .withColumn(out, F.col("__base") + F.col("__row"))
        .drop("__part", "__row", "__base")
    )


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, share: int = 1024) -> DataFrame:
    """``rows`` joined with ``groups``: tables, the latter with one row a key and in ``c`` how many
    of the ``total`` rows hold it. A key of more than a ``share``-th of all rows is joined by
    broadcast (there are fewer than ``share`` of them), so its rows stay where they are."""
    much = F.col("c") > F.lit(total / share)
    near = rows.join(F.broadcast(groups.where(much)), keys)  # fewer than ``share`` rows
    far = rows.join(F.broadcast(groups.where(much).select(*keys)), keys, "left_anti").join(groups.where(~much), keys)
    return near.unionByName(far)


# --------------------------------------------------------------------------- Python workers

BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 16 MB, however long the texts are; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def trimmed(run):
    """The batch function ``run``, which gives freed memory back when its task ends: workers
    live on between tasks and stages."""

    def with_trim(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not the GNU library
            pass

    return with_trim


# --------------------------------------------------------------------------- text slices


def byte_slices(column: pa.Array, limit: int = 2 << 20):
    """(first row, last row) ranges holding about ``limit`` bytes of text, one row at least."""
    if len(column) == 0:
        return
    offsets = value_offsets(column)
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        stop = min(max(stop, at + 1), len(column))
        yield at, stop
        at = stop


def value_offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind) if column.buffers()[1] is not None and column.buffers()[1].size else np.zeros(1, kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and their offsets from 0. The column holds no nulls."""
    offsets = value_offsets(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# --------------------------------------------------------------------------- hashing

_rng = np.random.Generator(np.random.PCG64(20240601))
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
WITHIN = 65521
PLACE = _rng.integers(0, 2**64, WITHIN, dtype=np.uint64) | np.uint64(1)
WORD = _rng.integers(0, 2**64, 5, dtype=np.uint64) | np.uint64(1)
SHORT = _rng.integers(0, 2**64, 6, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(buf: np.ndarray, ends: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every document, and the words' bounds by document.

    Words are maximal runs of bytes other than space and 0x09-0x0D, A-Z in lower case.
    ``ends`` are the documents' offsets in ``buf``, from 0. Worked off in chunks of whole words.
    """
    docs = len(ends) - 1
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    word = ~SEPARATOR[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = ends[1:-1]
    inner = inner[inner < len(buf)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = inner[inner > 0] - 1
    last[cut] = word[cut]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(stops, starts[at] + chunk, side="right")), at + 1)
        lengths = stops[at:to] - starts[at:to]
        edges = np.concatenate(([0], np.cumsum(lengths)))
        if to - at == 1:  # maybe a giant word: hashed piece by piece
            total, s = np.uint64(0), int(starts[at])
            for a in range(0, int(lengths[0]), chunk):
                b = min(a + chunk, int(lengths[0]))
                where = np.arange(a, b)
                total = total + (BYTE[LOWER[buf[s + a : s + b]]] * (PLACE[where % WITHIN] ^ (where // WITHIN).astype(np.uint64) * np.uint64(2))).sum(dtype=np.uint64)
            hashes[at] = total
        else:
            where = np.arange(edges[-1]) - np.repeat(edges[:-1], lengths)
            value = BYTE[LOWER[buf[np.repeat(starts[at:to], lengths) + where]]]
            value *= PLACE[where % WITHIN] ^ (where // WITHIN).astype(np.uint64) * np.uint64(2)
            hashes[at:to] = np.add.reduceat(value, edges[:-1])
        hashes[at:to] ^= lengths.astype(np.uint64) * WORD[0]
        at = to
    return mix(hashes), np.searchsorted(starts, ends)


def shingle_sets(buf: np.ndarray, ends: np.ndarray):
    """For each document its set of word 5-shingles as a sorted array of distinct 64-bit
    hashes (int64). With fewer words, the whole sequence is one; without words, none."""
    words, bounds = word_hashes(buf, ends)
    n = max(0, len(words) - SHINGLE + 1)
    sums = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        sums += words[j : j + n] * WORD[j]
    sums = mix(sums).view(np.int64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        count = b - a
        if count >= SHINGLE:
            got = np.sort(sums[a : b - SHINGLE + 1])
            if len(got) > 1:
                keep = np.empty(len(got), bool)
                keep[0] = True
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                got = got[keep]
            yield got
        elif count:
            with np.errstate(over="ignore"):
                one = (words[a:b] * WORD[:count]).sum(dtype=np.uint64) + SHORT[count]
            yield mix(np.array([one], np.uint64)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def set_key(values: np.ndarray) -> bytes:
    """128-bit identity of a shingle set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def text_binary(column: str = "text"):
    """Text as bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
