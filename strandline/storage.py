"""Tables in the folder that all executors share, to end lineage between steps."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset."""
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
    """A fresh path there, in a folder that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)  # only what exists is noted for removal
    system.deleteOnExit(hadoop)
    return f"{path}/data"


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table_of(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written as a Parquet table and read again, and its path."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def free_shuffles(spark: SparkSession) -> None:
    """Files of shuffles that no DataFrame refers to any more go once the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()
