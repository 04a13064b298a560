"""Nested cross-validation, fold-fitted preparation and scoring with MLlib.

Folds are filters on one table; the driver loops over folds, not over rows. Everything that
is fitted (medians, scaling, components) is fitted on the training rows of a model only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.statistics import auc


@dataclass
class Component:
    """A group of feature columns, by name or by pattern on names."""

    name: str
    kind: str
    columns: Sequence[str] = ()
    prefixes: Sequence[str] = ()


ENCODINGS = ("sparse", "blosum45", "blosum50", "blosum62", "blosum80", "blosum90", "kidera", "atchley", "compositional")


@dataclass
class FeatureSet:
    components: list[Component] = field(default_factory=list)

    def check(self) -> FeatureSet:
        """No component twice, and one encoding at most."""
        names = [c.name for c in self.components]
        if len(set(names)) < len(names):
            raise ValueError("a component repeats")
        if sum(n in ENCODINGS for n in names) > 1:
            raise ValueError("more than one encoding")
        return self

    def resolve(self, available: Sequence[str], metadata: Sequence[str] = ()) -> list[str]:
        """Columns of the components, in the table's order, without metadata."""
        wanted: list[str] = []
        for c in self.components:
            wanted += [a for a in available if a in c.columns or any(a.startswith(p) for p in c.prefixes)]
        return [a for a in available if a in set(wanted) and a not in metadata]


def classify_feature(name: str | Column) -> Column:
    """The kind of a feature, from its name: one symbol at one position of the window; a
    component of an embedding; all else is handcrafted (shares of symbols included)."""
    n = F.col(name) if isinstance(name, str) else name
    position = n.rlike("^([NC][1-9][0-9]*|P[1-9])_[^_]*$")
    component = n.rlike("^esmc_|^esmif_|PC")
    return F.when(position, "aa_encoding").when(component, "embedding_pca").otherwise("handcrafted")


MODELS = {
    "lr": lambda **o: LogisticRegression(maxIter=50, standardization=False, **o),
    "en": lambda **o: LogisticRegression(maxIter=50, standardization=False, **{"elasticNetParam": 0.5, **o}),
    "rf": lambda **o: RandomForestClassifier(**{"numTrees": 50, "featureSubsetStrategy": "sqrt", "maxDepth": 10, "seed": 42, **o}),
    "gbt": lambda **o: GBTClassifier(**{"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 42, **o}),
}


def finite(column: str) -> F.Column:
    """NaN and infinite values count as missing."""
    c = F.col(column).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of the training rows; 0 for a column without values."""
    row = train.agg(*[F.percentile(finite(c), F.lit(0.5)).alias(c) for c in columns]).first()
    return {c: 0.0 if row[c] is None else float(row[c]) for c in columns}


def fit_model(train: DataFrame, columns: Sequence[str], label: str = "label", kind: str = "lr", **options) -> PipelineModel:
    """Imputation, standardisation and a class-weighted model as one saved pipeline.
    Logistic models take ``C`` (default 1), the weight of the summed loss against the penalty: a
    ``regParam`` of 1 / (C n), as MLlib averages the loss."""
    fill = medians(train, columns)
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    total, classes = sum(counts.values()), max(1, len(counts))
    if kind in ("lr", "en"):
        strength = options.pop("C", 1.0)
        options.setdefault("regParam", 1.0 / (strength * max(1, total)))
    weight = " ".join(f"WHEN {k} THEN {total / (classes * n)!r}" for k, n in counts.items()) or "WHEN 1 THEN 1.0"
    parts = ", ".join(f"coalesce(CASE WHEN NOT isnan(cast(`{c}` AS double)) AND abs(`{c}`) < double('Infinity') THEN cast(`{c}` AS double) END, {fill[c]!r}D) AS `{c}__f`" for c in columns)
    prepare = SQLTransformer(statement=f"SELECT *, {parts} FROM __THIS__")
    weigh = SQLTransformer(statement=f"SELECT *, cast(CASE {label} {weight} ELSE 1.0 END AS double) AS weight__ FROM __THIS__")
    gather = VectorAssembler(inputCols=[f"{c}__f" for c in columns], outputCol="raw__")
    scale = StandardScaler(inputCol="raw__", outputCol="features", withMean=True)
    model = MODELS[kind](**options).setLabelCol(label).setFeaturesCol("features").setWeightCol("weight__")
    return Pipeline(stages=[prepare, weigh, gather, scale, model]).fit(train)


def score(model: PipelineModel, rows: DataFrame, row: str = "row_id", label: str = "label") -> DataFrame:
    if label not in rows.columns:
        rows = rows.withColumn(label, F.lit(0))
    return model.transform(rows).select(row, F.element_at(vector_to_array("probability"), 2).alias("prob"))


def nested_cv(df: DataFrame, columns: Sequence[str], folds: Sequence[int], label: str = "label", fold: str = "fold", kind: str = "lr", row: str = "row_id", **options) -> tuple[DataFrame, dict]:
    """For each outer fold one model for each other fold, trained without both; the
    outer rows are scored by the mean over these models. Returns row, fold, prob, and the models."""
    scored, models = None, {}
    for outer in folds:
        each = None
        for inner in folds:
            if inner == outer:
                continue
            train = df.where(~F.col(fold).isin(outer, inner))
            model = models[outer, inner] = fit_model(train, columns, label, kind, **options)
            s = score(model, df.where(F.col(fold) == outer), row, label)
            each = s if each is None else each.union(s)
        if each is not None:
            mean = each.groupBy(row).agg(F.avg("prob").alias("prob")).withColumn(fold, F.lit(outer))
            scored = mean if scored is None else scored.unionByName(mean)
    return scored, models


def score_external(models: Sequence[PipelineModel], rows: DataFrame, columns: Sequence[str], row: str = "row_id") -> DataFrame:
    """All models averaged; the rows must hold every feature column."""
    lacking = [c for c in columns if c not in rows.columns]
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")
    out = None
    for m in models:
        s = score(m, rows, row)
        out = s if out is None else out.union(s)
    return out.groupBy(row).agg(F.avg("prob").alias("prob"), F.count("*").alias("models"))


def feature_weights(models: Sequence[PipelineModel], columns: Sequence[str]) -> list[tuple[str, float, float]]:
    """Mean and deviation over models of coefficients or importances, largest first."""
    each = [np.array(m.stages[-1].coefficients if hasattr(m.stages[-1], "coefficients") else m.stages[-1].featureImportances.toArray()) for m in models]
    mean, sd = np.mean(each, axis=0), np.std(each, axis=0)
    order = sorted(range(len(columns)), key=lambda i: (-abs(mean[i]), columns[i]))
    return [(columns[i], float(mean[i]), float(sd[i])) for i in order]


def rebuild_out_of_fold(rows: DataFrame, runs: DataFrame, row: str = "row_id", fold: str = "fold", label: str = "y") -> DataFrame:
    """Scores kept as one array a fold, back at their rows; fails if a fold's length or a
    label differs."""
    listed = rows.groupBy(fold).agg(F.sort_array(F.collect_list(F.struct(row, label))).alias("_rows"))
    both = listed.join(runs, fold)
    both = both.withColumn("_rows", F.when(F.size("_rows") == F.size("scores"), F.col("_rows")).otherwise(F.raise_error(F.lit("a fold has another length"))))
    pairs = both.select(fold, F.explode(F.arrays_zip("_rows", "scores")).alias("z"))
    out = pairs.select(F.col(f"z._rows.{row}").alias(row), fold, F.col(f"z._rows.{label}").alias("_y"), F.col("z.scores.y_true").alias("_t"), F.col("z.scores.y_prob").alias("prob"))
    return out.withColumn("prob", F.when(F.col("_y") == F.col("_t"), F.col("prob")).otherwise(F.raise_error(F.lit("a label differs")))).drop("_y", "_t")


def univariate_logistic(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Odds ratio of each column (scaled by its deviation) with 95 % limits and p, by
    iteratively reweighted least squares on sums over all rows: two numbers of state a column."""
    rows = []
    for c in columns:
        stats = df.agg(F.avg(c), F.stddev_samp(c)).first()
        z = df.select(((F.col(c) - stats[0]) / (stats[1] or 1.0)).alias("x"), F.col(label).cast("double").alias("y")).where("x is not null")
        b = np.zeros(2)
        for _ in range(25):
            p = 1 / (1 + F.exp(-(F.lit(float(b[0])) + F.lit(float(b[1])) * F.col("x"))))
            w = p * (1 - p)
            s = z.agg(F.sum(F.col("y") - p), F.sum((F.col("y") - p) * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first()
            info = np.array([[s[2], s[3]], [s[3], s[4]]])
            step = np.linalg.solve(info, np.array([s[0], s[1]]))
            b += step
            if np.abs(step).max() < 1e-9 or np.abs(b).max() > 30:
                break
        if np.abs(b).max() > 30:  # the classes are separable: no finite estimate
            rows.append((c, None, None, None, None))
            continue
        se = math.sqrt(np.linalg.inv(info)[1, 1])
        rows.append((c, math.exp(b[1]), math.exp(b[1] - 1.96 * se), math.exp(b[1] + 1.96 * se), math.erfc(abs(b[1] / se) / math.sqrt(2))))
    return df.sparkSession.createDataFrame(rows, "feature string, odds_ratio double, low double, high double, p double")


def _oof_auc(x: np.ndarray, y: np.ndarray, fold: np.ndarray, ridge: float = 1.0) -> float:
    """Leave-one-fold-out area of a ridge regression on a few standardised columns."""
    out = np.zeros(len(y))
    for f in np.unique(fold):
        a, b = fold != f, fold == f
        mean, sd = x[a].mean(0), x[a].std(0)
        sd[sd == 0] = 1
        za, zb = (x[a] - mean) / sd, (x[b] - mean) / sd
        coef = np.linalg.solve(za.T @ za + ridge * np.eye(x.shape[1]), za.T @ (y[a] - y[a].mean()))
        out[b] = zb @ coef
    order = pd.Series(out).rank().to_numpy()
    n1 = y.sum()
    n0 = len(y) - n1
    return float((order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")


def screen_dimensions(df: DataFrame, window: str = "window", label: str = "y", fold: str = "fold") -> DataFrame:
    """How well each dimension's values over the slots tell the labels apart. One group
    a dimension: its column of slot values for the labelled rows, one model each."""
    flat = df.select("row_id", label, fold, F.posexplode(window).alias("slot", "v")).select("row_id", label, fold, "slot", F.posexplode("v").alias("dim", "value"))
    by_row = flat.groupBy("dim", "row_id", label, fold).agg(F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("s")).withColumn("s", F.transform("s", lambda x: x["value"]))

    def run(pdf):
        pdf = pdf.sort_values("row_id")
        a = _oof_auc(np.stack(pdf["s"]), pdf[label].to_numpy(), pdf[fold].to_numpy())
        return pd.DataFrame([{"dim": int(pdf["dim"].iloc[0]), "auc": a, "auc_disc": max(a, 1 - a)}])

    return by_row.groupBy("dim").applyInPandas(run, "dim int, auc double, auc_disc double")


def classifier_two_sample(spark: SparkSession, df: DataFrame, folds: int = 3, permutations: int = 200) -> DataFrame:
    """Balanced accuracy of telling two sides apart, out of fold, and its permutation p.
    Replicates are groups: each task holds all vectors once and fits one small model, so the
    table has to fit a task."""
    reps = df.select("vec_id", "embedding", "side", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("rep"))

    def run(pdf):
        pdf = pdf.sort_values("vec_id")
        x, y, rep = np.stack(pdf["embedding"]).astype(float), pdf["side"].to_numpy(), int(pdf["rep"].iloc[0])
        if rep:
            y = np.random.default_rng(rep).permutation(y)
        fold, hit = np.arange(len(y)) % folds, np.zeros(len(y), bool)
        for f in range(folds):
            a, b = fold != f, fold == f
            coef = np.linalg.solve(x[a].T @ x[a] + np.eye(x.shape[1]), x[a].T @ (2.0 * y[a] - 1))
            hit[b] = (x[b] @ coef > 0) == (y[b] == 1)
        return pd.DataFrame([{"rep": rep, "accuracy": float((hit[y == 1].mean() + hit[y == 0].mean()) / 2)}])

    acc = reps.groupBy("rep").applyInPandas(run, "rep int, accuracy double")
    own = F.max(F.when(F.col("rep") == 0, F.col("accuracy")))
    one = acc.agg(own.alias("balanced_accuracy"), F.collect_list(F.when(F.col("rep") > 0, F.col("accuracy"))).alias("null"))
    return one.select("balanced_accuracy", ((F.size(F.filter("null", lambda v: v >= F.col("balanced_accuracy"))) + 1) / (F.size("null") + 1)).alias("p"))


def run_matrix(df: DataFrame, sets: dict[str, Sequence[str]], kinds: Sequence[str], folds: Sequence[int], label: str = "label") -> DataFrame:
    """Models by feature sets, ranked by pooled out-of-fold area."""
    rows = []
    for name, columns in sets.items():
        for kind in kinds:
            scored, _ = nested_cv(df, columns, folds, label, kind=kind)
            value = auc(scored.join(df.select("row_id", label), "row_id"), "prob", label).first()["auc"]
            rows.append((kind, name, float(value)))
    rows.sort(key=lambda r: (-r[2], r[0], r[1]))
    return df.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "place int, model string, features string, auc double")
