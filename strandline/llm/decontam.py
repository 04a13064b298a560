"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle set. An item is searched by its
MinHash values: the least hashes of its own set, ``SKETCH`` of them, all if it has fewer. A
document is looked up with its full shingle set, however long, so a short item inside a
long document loses nothing to their difference in size (comparing two sketches would).
With containment c each of the item's values is in the document with chance c; a
partition asks for as many hits as 0.75 misses with chance below 1e-9, at full
sketches for sure. Only document shingles up to a partition's greatest retained hash are
probed. Candidates are verified by exact containment of the full shingle sets.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import bound_batches, byte_slices, raw_bytes, shingle_sets, text_binary, trimmed

SKETCH = 48
#: Items whose index is sent to the executors at once (under about 64 MB); more make more passes.
BLOCK_SHINGLES = 2_000_000


def needed_hits(size: int, percent: int, sketch: int = SKETCH) -> int:
    """Hits among an item's retained values that a true containment misses with chance < 1e-9."""
    if size <= sketch:
        return -(-size * percent // 100)
    p, total, hits = percent / 100, 0.0, 0
    while True:
        total += comb(sketch, hits) * p**hits * (1 - p) ** (sketch - hits)
        if total > 1e-9:
            return max(hits, 1)
        hits += 1


class _Index:
    """The retained values of the items of one size partition."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sets = [s for _, s in items]
        kept = [s[:SKETCH] for s in self.sets]
        self.needs = np.array([needed_hits(len(s), percent) for s in self.sets])
        owner = np.repeat(np.arange(len(items)), [len(k) for k in kept])
        values = np.concatenate(kept)
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.top = values[order], owner[order], values.max()
        self.distinct = self.values[np.flatnonzero(np.concatenate(([True], self.values[1:] != self.values[:-1])))]

    def candidates(self, doc: np.ndarray) -> np.ndarray:
        probe = doc[: np.searchsorted(doc, self.top, side="right")]
        at = np.searchsorted(self.distinct, probe)
        at[at == len(self.distinct)] = 0
        found = probe[self.distinct[at] == probe]
        if not len(found):
            return np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.values, found, "left"), np.searchsorted(self.values, found, "right")
        owners = np.concatenate([self.owner[a:b] for a, b in zip(lo, hi)])
        hits = np.bincount(owners, minlength=len(self.ids))
        return np.flatnonzero((hits >= self.needs) & (hits > 0))


def _blocks(benchmark: DataFrame, limit: int):
    """Items in blocks of at most ``limit`` shingles, from a streamed read of the benchmark."""
    block, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), text_binary().alias("text")).orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        text = np.frombuffer(row["text"], np.uint8)
        (one,) = shingle_sets(text, np.array([0, len(text)]))
        if row["item_id"] is None or not len(one):
            continue
        if block and held + len(one) > limit:
            yield block
            block, held = [], 0
        block.append((row["item_id"], one))
        held += len(one)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_item, n_shared for every document that holds at least ``percent``
    per cent of a test item's word 5-shingles.

    An item of fewer than five words is one shingle, its whole sequence, and matches only
    documents of that sequence. Items without words or id and documents without words match
    nothing; null doc_ids are reported as null; repeated rows repeat their results (equal
    items of one id: once for each). Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    schema = "doc_id long, item_id long, n_item long, n_shared long"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_binary().alias("text"))
    out = None
    for block in _blocks(benchmark, block_shingles):
        by_size: dict[int, list] = {}
        for item in block:
            by_size.setdefault(len(item[1]).bit_length(), []).append(item)
        indexes = [_Index(items, percent) for _, items in sorted(by_size.items())]
        sent = spark.sparkContext.broadcast(indexes)  # at most block_shingles hashes

        def search(batches, sent=sent):
            for batch in batches:
                column, rows = batch.column("text"), []
                ids = batch.column("doc_id").to_pylist()
                for a, b in byte_slices(column):
                    for doc, s in zip(ids[a:b], shingle_sets(*raw_bytes(column.slice(a, b - a)))):
                        for index in sent.value if len(s) else ():
                            for i in index.candidates(s):
                                item = index.sets[i]
                                shared = _shared(s, item)
                                if 100 * shared >= percent * len(item):
                                    rows.append((doc, int(index.ids[i]), len(item), shared))
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_item", "n_shared"])

        found = source.mapInArrow(trimmed(search), schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, percent: int = 75, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns, without an exchange."""
    spark = docs.sparkSession
    bound_batches(spark)
    for block in _blocks(benchmark, block_shingles):
        by_size: dict[int, list] = {}
        for item in block:
            by_size.setdefault(len(item[1]).bit_length(), []).append(item)
        sent = spark.sparkContext.broadcast([_Index(items, percent) for _, items in sorted(by_size.items())])

        def keep(batches, sent=sent):
            for batch in batches:
                column = batch.column("_searched")
                clean = np.ones(batch.num_rows, bool)
                for a, b in byte_slices(column):
                    for i, s in enumerate(shingle_sets(*raw_bytes(column.slice(a, b - a))), a):
                        clean[i] = not any(100 * _shared(s, index.sets[j]) >= percent * len(index.sets[j]) for index in (sent.value if len(s) else ()) for j in index.candidates(s))
                yield batch.filter(pa.array(clean)).drop_columns(["_searched"])

        docs = docs.withColumn("_searched", text_binary()).mapInArrow(trimmed(keep), docs.schema)
    return docs


def _shared(doc: np.ndarray, item: np.ndarray) -> int:
    at = np.searchsorted(doc, item)
    at[at == len(doc)] = 0
    return int((doc[at] == item).sum())
