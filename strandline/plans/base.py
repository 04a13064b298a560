"""The observation tables that the queries run on, made from the driver's tables.

``documents`` stand for proteins (upper-case letters of the text), 9-symbol windows of them
for peptides, ``labels.quality`` for the label, a fixed arithmetic of the ids for the rank.
``row_id`` replaces row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.rows import complete_flanks, cut_windows

FLANK = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence")).withColumn("len", F.length("sequence"))


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).where("len >= 60")


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    # a filter on the length would be pushed below and work out the letters once more
    rows = _letters(spark, sf_dir).withColumn("used", F.expr("if(len >= 60, sequence, '')")).join(labels, "doc_id")
    each = cut_windows(rows, "used", 9, 40, FLANK)
    rank = (F.col("doc_id") * 7919 + F.col("start") * 31) % 2000 / F.lit(1000.0)
    return each.select((F.col("doc_id") * 1000000 + F.col("start")).alias("row_id"), "doc_id", "lang", "source", "sequence", "len", "start", "stop", "peptide", "label", "toxic", rank.alias("rank"), "raw_n", "raw_c")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).drop("raw_n", "raw_c")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_flanks(_cut(spark, sf_dir), FLANK).drop("raw_n", "raw_c")


PROT = """prot AS (SELECT doc_id, lang, source, sequence, length(sequence)::INT AS len FROM
  (SELECT doc_id, lang, source, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents) WHERE length(sequence) >= 60)"""
OBS = PROT + """,
obs AS (SELECT doc_id * 1000000 + start AS row_id, doc_id, lang, source, sequence, len, start, start + 8 AS stop, substr(sequence, start, 9) AS peptide, label, toxic,
    ((doc_id * 7919 + start * 31) % 2000) / 1000.0::DOUBLE AS rank
  FROM (SELECT p.*, l.quality AS label, l.toxic, unnest(range(1, len - 7, 40))::INT AS start FROM prot p JOIN labels l USING (doc_id)))"""
WIN = OBS + """,
win AS (SELECT *, length(raw_n)::INT AS n_real, length(raw_c)::INT AS c_real, lpad(raw_n, 5, 'X') AS n_flank, rpad(raw_c, 5, 'X') AS c_flank,
    lpad(raw_n, 5, 'X') || peptide || rpad(raw_c, 5, 'X') AS context, (start - 1) / len::DOUBLE AS rel_n, (len - stop) / len::DOUBLE AS rel_c
  FROM (SELECT *, substr(sequence, greatest(1, start - 5), start - greatest(1, start - 5)) AS raw_n, substr(sequence, stop + 1, greatest(0, least(5, len - stop))) AS raw_c FROM obs))"""
