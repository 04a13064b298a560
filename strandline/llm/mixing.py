"""Mixing sources to target weights by proportionate-fair scheduling.

The rows of a source, in a seeded shuffle, form blocks. With target weight w, its block i
(from 0) is released at slot floor(i / w) and due by slot ceil((i + 1) / w). Earliest
deadline first over the released blocks gives one block a slot, and at any slot t every
source has had w * t blocks, within less than one block.

Weights are taken exactly: a double is a fraction, so all are scaled to whole numbers in the
same ratio, and releases and deadlines are whole-number divisions. Every source has its own
share, however many there are. The driver deals the blocks (a step a block, whatever the
number of sources) and the workers look their rows' blocks up. When a source runs out its
phase ends, and the sources left share the following slots in proportion to their weights;
so no row is dropped or repeated.

``quantize``, ``one_period`` and ``plan_phases`` are the periodic form, for weights that are
whole parts of a short period.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import global_position

def quantize(weights: list[float], resolution: int) -> list[int]:
    """Whole parts of ``resolution`` by largest remainder, one at least each; they sum to it."""
    total = sum(weights)
    exact = [w / total * resolution for w in weights]
    parts = [max(1, int(x)) for x in exact]
    order = sorted(range(len(parts)), key=lambda i: (-(exact[i] - int(exact[i])), i))
    for i in order * (1 + abs(resolution - sum(parts)) // max(1, len(parts))):
        if sum(parts) >= resolution:
            break
        parts[i] += 1
    while sum(parts) > resolution:
        parts[max(range(len(parts)), key=lambda i: (parts[i], -i))] -= 1
    return parts


def window(index: int, part: int, period: int) -> tuple[int, int]:
    """Release and deadline of block ``index`` of a source with weight part / period."""
    return index * period // part, -(-(index + 1) * period // part)


def one_period(parts: list[int]) -> list[np.ndarray]:
    """The slots of each source's blocks over one period, earliest deadline first."""
    period = sum(parts)
    slots: list[list[int]] = [[] for _ in parts]
    waiting = [(0, s, 0) for s in range(len(parts))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (window(i, parts[s], period)[1], s, i))
        due, s, i = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        slots[s].append(t)
        if i + 1 < parts[s]:
            heapq.heappush(waiting, (window(i + 1, parts[s], period)[0], s, i + 1))
    return [np.array(x, np.int64) for x in slots]


def plan_phases(blocks: list[int], weights: list[float], resolution: int) -> Iterator[dict]:
    """Phases until all blocks are dealt: first slot, active sources, their parts, their
    period slots, the index of their first block and the index after their last."""
    left = [(s, 0) for s in range(len(blocks)) if blocks[s] > 0]
    start = 0
    while left:
        period = max(resolution, 2 * len(left))
        parts = quantize([weights[s] for s, _ in left], period)
        slots = one_period(parts)
        ends = []
        for (s, done), k, at in zip(left, parts, slots):
            last = blocks[s] - done - 1
            ends.append((last // k) * period + int(at[last % k]) + 1)
        length = min(ends)
        phase = {"start": start, "period": period, "length": length, "sources": [], "parts": parts, "slots": slots, "first": [], "stop": []}
        following = []
        for (s, done), k, at in zip(left, parts, slots):
            took = (length // period) * k + int(np.searchsorted(at, length % period))
            phase["sources"].append(s)
            phase["first"].append(done)
            phase["stop"].append(done + took)
            if done + took < blocks[s]:
                following.append((s, done + took))
        yield phase
        left, start = following, start + length


def whole_shares(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the ratio of the weights."""
    exact = [Fraction(w) for w in weights]
    if any(x < 0 for x in exact):
        raise ValueError("weights must not be negative")
    scale = math.lcm(*(x.denominator for x in exact))
    whole = [int(x * scale) for x in exact]
    common = math.gcd(*whole) or 1
    return [x // common for x in whole]


def deal(blocks: list[int], weights: list[float]) -> tuple[dict[str, np.ndarray], list[int], list[int]]:
    """phase, release, deadline and slot of every block (those of source 0 first), and the
    first slot of each phase and the source that ran out at its end.

    Sources of weight 0 come after all others, with equal shares. Of blocks due alike the one
    of the greater weight goes first; then those released with a phase are in one order for
    all phases, and a phase costs what it deals.
    """
    offsets = [0, *np.cumsum(blocks, dtype=np.int64).tolist()]
    out = {c: np.zeros(offsets[-1], np.int64) for c in ("phase", "release", "deadline", "slot")}
    share = whole_shares(weights)
    taken = [0] * len(blocks)
    top = 2**63 - 1
    starts: list[int] = []
    ended: list[int] = []
    start = 0
    for names in ([s for s, k in enumerate(share) if k > 0], [s for s, k in enumerate(share) if k == 0]):
        fresh = sorted((s for s in names if blocks[s] > 0), key=lambda s: (-share[s], s))
        for s in fresh:
            share[s] = share[s] or 1
        total = sum(share[s] for s in fresh)
        while fresh:
            ready: list[tuple[int, int, int]] = []
            waiting: list[tuple[int, int]] = []
            dealt: dict[int, int] = {}
            t = seen = 0
            while True:
                while waiting and waiting[0][0] <= t:
                    _, s = heapq.heappop(waiting)
                    heapq.heappush(ready, (window(dealt[s], share[s], total)[1], -share[s], s))
                first = (window(0, share[fresh[seen]], total)[1], -share[fresh[seen]], fresh[seen]) if seen < len(fresh) else None
                if first is not None and (not ready or first < ready[0]):
                    due, _, s = first
                    seen += 1
                else:
                    due, _, s = heapq.heappop(ready)
                if due <= t:
                    raise AssertionError("a deadline was missed")
                i, at = dealt.get(s, 0), offsets[s] + taken[s]
                out["phase"][at], out["release"][at], out["deadline"][at], out["slot"][at] = len(starts), window(i, share[s], total)[0], min(due, top), start + t
                dealt[s] = i + 1
                taken[s] += 1
                t += 1
                if taken[s] == blocks[s]:
                    break
                heapq.heappush(waiting, (window(i + 1, share[s], total)[0], s))
            starts.append(start)
            ended.append(s)
            start += t
            fresh.remove(s)
            total -= share[s]
    return out, starts, ended


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 16, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, block, phase, release, deadline, slot and position of every row.

    ``weights`` are the target shares by source; without them a source's share follows the
    square root of its rows. Null sources, and with ``weights`` the sources without one, are
    pooled as one (its share: the smallest given weight, or by the same rule); the order of
    rows in the pool is the shuffle of all its rows.
    ``position`` is gapless from 0: the order by slot, then by rank in the block.
    Release and deadline count slots of the phase, from its own start.

    Null ids come first among ties, repeated rows each get a place, an empty table gives an
    empty result, and other columns than ``carry``, which are passed on, are ignored.
    """
    spark = docs.sparkSession
    if weights:
        named = sorted(weights.items(), key=lambda x: (-x[1], x[0]))
    else:
        own = docs.where("source is not null").groupBy("source").count().orderBy(F.desc("count"), "source").collect()
        named = [(r["source"], float(r["count"]) ** 0.5) for r in own]
    codes = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(named)] or [("", -1)], "source string, _code int")
    pool = len(named)
    slim = (
        docs.select(*carry, F.col("doc_id").cast("long").alias("doc_id"), "source", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_h"))
        .join(F.broadcast(codes), "source", "left")  # a row a source
        .withColumn("_code", F.coalesce("_code", F.lit(pool)))
    )
    ranked = global_position(slim, ["_code", "_h", "doc_id", "source"], "mix-rank", "_at")
    counts = {r["_code"]: (r["n"], r["first"]) for r in ranked.groupBy("_code").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect()}
    rows = [counts.get(c, (0, 0))[0] for c in range(pool + 1)]
    firsts = np.array([counts.get(c, (0, 0))[1] for c in range(pool + 1)], np.int64)
    shares = [w for _, w in named] + [min((w for _, w in named), default=1.0) if weights else max(rows[pool], 1) ** 0.5]
    blocks = [-(-n // block_rows) for n in rows]
    plan, _, ended = deal(blocks, shares)

    # rows before a slot: whole blocks but for the short last blocks of sources that ran out before
    short = np.cumsum([0] + [blocks[s] * block_rows - rows[s] for s in ended], dtype=np.int64)
    offsets = np.cumsum([0, *blocks], dtype=np.int64)
    sent = spark.sparkContext.broadcast((plan, short, offsets, firsts))

    def place(batches):
        plan, short, offsets, firsts = sent.value
        for pdf in batches:
            code = pdf["_code"].to_numpy()
            rank = pdf["_at"].to_numpy() - firsts[code]
            block = rank // block_rows
            out = {c: x[offsets[code] + block] for c, x in plan.items()}
            position = out["slot"] * block_rows - short[out["phase"]] + rank % block_rows
            yield pd.DataFrame({**{c: pdf[c] for c in carry}, "doc_id": pdf["doc_id"].astype("Int64"), "source": pdf["source"], "block": block, **out, "position": position})

    kept = "".join(f"{c} {ranked.schema[c].dataType.simpleString()}, " for c in carry)
    return ranked.select(*carry, "doc_id", "source", "_code", "_at").mapInPandas(place, kept + "doc_id long, source string, block long, phase long, release long, deadline long, slot long, position long")


def deviation(positions: list[tuple[int, str]], weights: dict[str, Fraction]) -> float:
    """Largest distance of any source's dealt blocks from weight times slots, for tests."""
    dealt = dict.fromkeys(weights, 0)
    worst = Fraction(0)
    for t, (_, source) in enumerate(sorted(positions), 1):
        dealt[source] += 1
        worst = max(worst, *(abs(dealt[s] - weights[s] * t) for s in weights))
    return float(worst)
