"""Exact top-k search by multi-resolution segment statistics.

Vectors are cut into equal segments at several resolutions. From a segment's mean and
deviation in query and candidate follows an upper bound of the inner product (for the
distance, a lower bound): the product of the means plus, by Cauchy-Schwarz, the product of
the deviations, times the segment's length, summed. Bounds are taken coarse to fine, each
on the survivors of the one before, and exact products are computed for what is left.

Vectors are packed into blocks; the stated query set is packed likewise and meets the
candidates block by block, so a task holds two blocks and its k best scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._common import NULL_ID, bound_batches, global_position, materialize

BLOCK = 4096
QUERY_BLOCK = 1024
LEVELS = (1, 4, 16)
LARGEST = float(np.finfo(np.float64).max)


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(length) times mean and sqrt of the sum of squared deviations, by row and segment;
    a last shorter segment is allowed."""
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))[:-1]
    lengths = np.diff(np.append(edges, x.shape[1]))
    sums = np.add.reduceat(x, edges, axis=1)
    squares = np.add.reduceat(x * x, edges, axis=1)
    return sums / np.sqrt(lengths), np.sqrt(np.maximum(squares - sums * sums / lengths, 0))


def block_top(queries: np.ndarray, q_uid: np.ndarray, rows: np.ndarray, uid: np.ndarray, k: int, levels=LEVELS):
    """(query index, row index, score) of each query's k best rows of a block, its own left out.

    Ties at the k-th score are all kept (the row order decides later).
    """
    exact = np.float64 if rows.shape[1] * float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) < 2**52 else None
    if exact is None:
        return _large_top(queries, q_uid, rows, uid, k)
    q, c = queries.astype(exact), rows.astype(exact)
    stats = [(segment_statistics(q, s), segment_statistics(c, s)) for s in levels]
    # the exact scores of the rows that look best at the coarsest level set a first threshold
    (qm, qd), (cm, cd) = stats[-1]
    out = []
    take = min(len(c), 4 * k + 1)
    first = np.argpartition(-(qm @ cm.T), take - 1, axis=1)[:, :take]
    for i in range(len(q)):
        got = c[first[i]] @ q[i]
        got = np.sort(got[uid[first[i]] != q_uid[i]])[::-1]
        floor = got[k - 1] if len(got) >= k else -np.inf
        alive = np.flatnonzero(uid != q_uid[i])
        for (qm, qd), (cm, cd) in stats:
            bound = cm[alive] @ qm[i] + cd[alive] @ qd[i]
            slack = 1e-9 * (1 + np.abs(bound))
            alive = alive[bound + slack >= floor]
        score = c[alive] @ q[i]
        if len(score) > k:
            floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
        keep = score >= floor
        out += [(i, int(j), int(s)) for j, s in zip(alive[keep], score[keep])]
    return out


def _large_top(queries: np.ndarray, q_uid: np.ndarray, rows: np.ndarray, uid: np.ndarray, k: int):
    """``block_top`` beyond the exact range of doubles: products in doubles with the bound of their
    error name the rows that may be best, whole numbers of any size decide between these."""
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        for i, q in enumerate(queries):
            near, wide = rows @ q, (np.abs(rows) @ np.abs(q)) * (rows.shape[1] + 2) * 2.0**-52
            low, high = (np.where(np.isnan(x), side, x) for x, side in ((near - wide, -np.inf), (near + wide, np.inf)))
            others = np.flatnonzero(uid != q_uid[i])
            if not len(others):
                continue
            floor = np.sort(low[others])[::-1][min(k, len(others)) - 1]
            whole = [int(x) for x in q]
            scores = {int(j): sum(a * int(b) for a, b in zip(whole, rows[j])) for j in others[high[others] >= floor]}
            least = sorted(scores.values(), reverse=True)[min(k, len(scores)) - 1]
            out += [(i, j, s) for j, s in scores.items() if s >= least]
    return out


def _place(score: int) -> bytes:
    """Bytes in the order of the scores that 64 bits can't tell apart; nothing for all others."""
    if -(2**63) < score < 2**63 - 1:
        return b""
    size = (abs(score).bit_length() + 7) // 8
    raw = b"\x80" + size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return raw if score > 0 else bytes(255 - x for x in raw)


def pack(vectors: DataFrame, scale: int, block: int = BLOCK) -> DataFrame:
    """Blocks of whole-number vectors floor(scale * x): block, dim, n, ids, data."""

    def run(batches):
        for batch in batches:
            vec = batch.column("v")
            rows: dict[int, list] = {}
            for i, v in enumerate(vec):
                if not v.is_valid:
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if x.dtype == object or not len(x):
                    continue
                x = x.astype(np.float64)
                if v.values.null_count or not (np.abs(x) < LARGEST / scale).all():
                    continue
                rows.setdefault(len(x), []).append((i, np.floor(scale * x)))
            ids = batch.column("id")
            for dim, got in rows.items():
                for at in range(0, len(got), block):
                    some = got[at : at + block]
                    data = np.stack([x for _, x in some])
                    own = ids.take(pa.array([i for i, _ in some])).fill_null(NULL_ID).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(some)], pa.int32()), pa.array([own.astype(np.int64).tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["dim", "n", "ids", "data"])

    packed = vectors.mapInArrow(run, "dim int, n int, ids binary, data binary")
    return materialize(packed.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")


def top_k(vectors: DataFrame, k: int = 5, modulus: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query (an id
    divisible by ``modulus``) with every other row, ties to the smaller id.

    Vectors null, empty, or holding null components or ones that aren't finite once scaled take no
    part; vectors of different lengths don't meet. Scores beyond 64 bits order exactly and are returned as the limit. Rows with a null id are candidates (last among ties) and no
    queries. A repeated row is another candidate, and another query with results of its own.
    """
    bound_batches(vectors.sparkSession)
    blocks = pack(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), scale)

    def queries(batches):
        held: dict[int, list] = {}

        def out(dim):
            got = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([b"".join(g[i] for g in got)], pa.binary()) for i in range(4))], names=["dim", "q_ids", "q_blocks", "q_rows", "q_data"])

        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                own = np.flatnonzero((ids % modulus == 0) & (ids != NULL_ID))
                data = np.frombuffer(r["data"], np.float64).reshape(-1, r["dim"])
                held.setdefault(r["dim"], []).append((ids[own].tobytes(), np.full(len(own), r["block"], np.int64).tobytes(), own.astype(np.int64).tobytes(), data[own].tobytes()))
                if sum(len(g[0]) for g in held[r["dim"]]) >= 8 * QUERY_BLOCK:
                    yield out(r["dim"])
        for dim in list(held):
            yield out(dim)

    kinds = "dim int, q_ids binary, q_blocks binary, q_rows binary, q_data binary"
    asked = blocks.select("block", "dim", "ids", "data").mapInArrow(queries, kinds).where("length(q_ids) > 0")
    asked = global_position(asked.withColumn("_id", F.monotonically_increasing_id()), ["dim", "_id"], "vector-queries", "q")
    numbers = asked.groupBy("dim").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    # each candidate block meets each query block of its length: the stated query set against all rows, in blocks
    pairs = blocks.select("block", "dim").join(F.broadcast(numbers), "dim").select("block", F.explode(F.expr("sequence(lo, hi)")).alias("q"))  # a row a vector length
    met = pairs.join(blocks, "block").join(asked.drop("dim", "_id"), "q")

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                q_ids, q_blocks, q_rows = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "q_blocks", "q_rows"))
                ids = np.frombuffer(r["ids"], np.int64)
                own = np.where(q_blocks == r["block"], q_rows, -1)
                rows = block_top(np.frombuffer(r["q_data"]).reshape(-1, dim), own, np.frombuffer(r["data"]).reshape(-1, dim), np.arange(len(ids)), k)
                keep: dict[int, list] = {}
                for i, j, s in rows:
                    keep.setdefault(i, []).append((-s, ids[j] == NULL_ID, int(ids[j])))
                rows = [(int(q_blocks[i]), int(q_rows[i]), int(q_ids[i]), v, max(-(2**63), min(2**63 - 1, -s)), _place(-s)) for i, got in keep.items() for s, _, v in sorted(got)[:k]]
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.binary())], names=["q_block", "q_row", "query_id", "vec_id", "score", "place"])

    best = met.select("block", "dim", "ids", "data", "q_ids", "q_blocks", "q_rows", "q_data").mapInArrow(search, "q_block long, q_row long, query_id long, vec_id long, score long, place binary")
    best = best.withColumn("vec_id", F.when(F.col("vec_id") != NULL_ID, F.col("vec_id")))
    order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), F.desc("place"), F.col("vec_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
