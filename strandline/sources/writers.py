"""Writers: tables, distinct lists, FASTA batches, routed outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.order import batched


def write_table(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """The whole target is replaced; Spark's committer makes files appear at once."""
    df.write.mode("overwrite").options(**({"header": True} if kind == "csv" else {}) | options).format(kind).save(path)


def distinct_list(df: DataFrame, column: str, separator: str = ",", ordered: bool = False) -> DataFrame:
    """The distinct values in one text (for short lists that a person hands on)."""
    values = df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct()
    gathered = F.collect_list("v")
    return values.agg(F.array_join(F.sort_array(gathered) if ordered else gathered, separator).alias("list"))


def fasta_batches(df: DataFrame, path: str, header: str = "header", sequence: str = "sequence", size: int = 500) -> DataFrame:
    """Records in contiguous batches, one folder each; returns the batch of each record."""
    out = batched(df.select(header, sequence), [header, sequence], size)
    text = F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(sequence))
    out.select("batch", text.alias("value")).repartition("batch").write.mode("overwrite").partitionBy("batch").text(path)
    return out


def routed(df: DataFrame, column: str = "acc") -> DataFrame:
    """Identifiers by class, with their least start, greatest end and count."""
    acc = F.col(column)
    kind = F.when(acc.rlike("^[A-Z0-9]{6,10}-[0-9]+$"), "isoform").when(acc.rlike("^[A-Z0-9]{6,10}$"), "canonical").otherwise("invalid")
    return df.groupBy(kind.alias("kind"), column).agg(F.min("start").alias("lo"), F.max("stop").alias("hi"), F.count("*").alias("n"))
