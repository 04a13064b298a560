"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded shuffle, the fractional rank
(rank - 1/2) / rows-of-the-source puts all sources on one scale, and the order by
fractional rank is cut into shards whose row counts differ by at most one. Up to any cut a
source with the share p of the corpus has its share of the rows within 1/2 + p * sources / 2,
so a shard holds the mixture within twice that many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import global_position


def shard_documents(docs: DataFrame, shards: int = 8, seed: str = "shards") -> DataFrame:
    """doc_id, source, size, text_crc32, position, shard, slot for every row of ``docs``.

    Both ranks are exact positions in range-dealt slim rows, so a source with a third of
    the rows is spread over many tasks. Null sources form a stratum of their own; a null
    text has size 1 and the checksum of the empty string; null ids come first among ties;
    repeated rows each get a place. Columns other than doc_id, text and source are ignored.
    An empty table gives an empty result.
    """
    size = F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long") + 1
    slim = docs.select(
        "doc_id",
        "source",
        size.alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_h"),
    )
    # nulls first, then by name; the flag tells a null source from an empty name
    slim = slim.withColumn("_none", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit("")))
    ranked = global_position(slim, ["_none", "_name", "_h", "doc_id", "text_crc32"], "shard-rank", "_at")
    strata = ranked.groupBy("_none", "_name").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ranked = ranked.join(strata, ["_none", "_name"])
    rank = F.col("_at") - F.col("_first") + 1
    ranked = ranked.withColumn("_frac", (2 * rank - 1).cast("double") / (2 * F.col("_n")).cast("double"))
    placed = global_position(ranked, ["_frac", "_none", "_name", "_h", "doc_id", "text_crc32"], "shard-place", "position")
    total = placed.agg(F.count("*")).first()[0]
    # shard s takes the positions from ceil(s * total / shards)
    shard = F.expr(f"cast((position * {shards}) div {max(total, 1)} as int)")
    first = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - first).select(
        "doc_id", "source", "size", "text_crc32", "position", "shard", "slot"
    )
