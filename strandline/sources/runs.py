"""What a run leaves behind, and how it is read again.

A run is a folder: ``models/outer{o}_inner{i}`` (whole pipelines, with their imputation and
scaling), ``predictions`` (a Parquet row a scored row, not arrays), ``features`` (the names in
order) and ``results``, a JSON document that ``readers.read_runs`` reads. ``results`` is written
last, so a folder that holds one is whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.modelling import feature_weights
from strandline.operators.statistics import auc
from strandline.sources.writers import write_table
from strandline.storage import remove

TOP = 50


def save_run(path: str, run_tag: str, model_key: str, features_key: str, models: Mapping[tuple[int, int], PipelineModel], columns: Sequence[str], scored: DataFrame, labels: DataFrame, row: str = "row_id", fold: str = "fold", label: str = "label") -> dict:
    """``models`` and ``scored`` as ``nested_cv`` returns them; ``labels`` holds row and label.
    A run of the same folder is replaced. Returns the document."""
    spark = scored.sparkSession
    remove(spark, f"{path}/results")
    remove(spark, f"{path}/models")
    for (outer, inner), model in models.items():
        model.write().overwrite().save(f"{path}/models/outer{outer}_inner{inner}")
    predictions = scored.select(row, fold, "prob").join(labels.select(row, label), row)
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    spark.createDataFrame(list(enumerate(columns)), "place int, name string").coalesce(1).write.mode("overwrite").json(f"{path}/features")
    kept = spark.read.parquet(f"{path}/predictions")
    areas = auc(kept, "prob", label, by=[fold]).agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std")).first()
    weights = feature_weights(list(models.values()), columns)[:TOP] if models else []
    document = {
        "model_key": model_key,
        "features_key": features_key,
        "run_tag": run_tag,
        "n_models": len(models),
        "cv_summary": {"roc_auc": {"mean": areas["mean"], "std": areas["std"]}},
        "avg_feature_weights": [{"name": n, "mean": m, "std": s} for n, m, s in weights],
    }
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/results")
    return document


def load_run(spark: SparkSession, path: str) -> tuple[dict, list[str], dict[tuple[int, int], PipelineModel], DataFrame]:
    """The document, the feature names in order, the models and the predictions."""
    document = json.loads(spark.read.text(f"{path}/results").first()["value"])
    names = [r["name"] for r in spark.read.schema("place int, name string").json(f"{path}/features").orderBy("place").collect()]
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/models")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in system.listStatus(folder)) if system.exists(folder) else []
    models = {}
    for name in found:
        outer, inner = map(int, re.fullmatch(r"outer(\d+)_inner(\d+)", name).groups())
        models[outer, inner] = PipelineModel.load(f"{path}/models/{name}")
    if len(models) != document["n_models"]:
        raise ValueError(f"{path} holds {len(models)} models of {document['n_models']}")
    return document, names, models, spark.read.parquet(f"{path}/predictions")


def write_ranking(ranked: DataFrame, path: str) -> None:
    """The ranked runs as one tab-separated file, best first."""
    write_table(ranked.coalesce(1).sortWithinPartitions("place"), path, "csv", sep="\t")
