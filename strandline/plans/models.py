"""Modelling queries on event scores and embeddings: rows only, since fitted models aren't SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import modelling as M
from strandline.plans.base import table
from strandline.plans.registry import query
from strandline.sources import runs
from strandline.sources.readers import read_runs
from strandline.storage import new_path, table_of

FOLDS = (0, 1, 2)
COLUMNS = [f"e{i}" for i in range(6)]


def samples(spark, sf):
    e = table(spark, sf, "embeddings")
    out = e.select(F.col("vec_id").alias("row_id"), (F.col("label") < 5).cast("int").alias("label"), (F.col("vec_id") % 3).cast("int").alias("fold"), *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate(COLUMNS)])
    return table_of(out.withColumn("e0", F.when(F.col("row_id") % 17 != 0, F.col("e0"))), "samples")[0]


@query()
def m01_m02_m03_m04_nested_cv(spark, sf):
    scored, _ = M.nested_cv(samples(spark, sf), COLUMNS, FOLDS)
    return scored


@query("""WITH n AS (SELECT DISTINCT unnest(['P' || (event_id % 12) || '_A', 'N' || (event_id % 5 + 1) || '_x_y', 'esmc_' || event_id % 9, event_type || '_PC' || event_id % 9, 'frac_' || event_type]) AS name FROM events)
SELECT name, CASE WHEN regexp_matches(name, '^([NC][1-9][0-9]*|P[1-9])_[^_]*$') THEN 'aa_encoding' WHEN starts_with(name, 'esmc_') OR starts_with(name, 'esmif_') OR contains(name, 'PC') THEN 'embedding_pca' ELSE 'handcrafted' END AS kind FROM n""")
def p27_feature_kinds(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.col("event_id").alias("i"))
    names = F.expr("array(concat('P', i % 12, '_A'), concat('N', i % 5 + 1, '_x_y'), concat('esmc_', i % 9), concat(event_type, '_PC', i % 9), concat('frac_', event_type))")
    return e.select(F.explode(names).alias("name")).distinct().select("name", M.classify_feature("name").alias("kind"))


@query()
def m05_forest_weights(spark, sf):
    """Mean importance of each column over the models of a run."""
    df = samples(spark, sf)
    models = [M.fit_model(df.where(F.col("fold") != f), COLUMNS, kind="rf", numTrees=10, maxDepth=4) for f in FOLDS]
    return spark.createDataFrame([(n, m, s) for n, m, s in M.feature_weights(models, COLUMNS)], "feature string, mean double, sd double")


@query()
def m06_m10_external_scores(spark, sf):
    """Boosted trees trained on folds, all of them averaged on rows they never saw."""
    df = samples(spark, sf)
    models = [M.fit_model(df.where(f"fold <> {f} and row_id % 5 <> 0"), COLUMNS, kind="gbt", maxIter=5, maxDepth=3) for f in FOLDS]
    return M.score_external(models, df.where("row_id % 5 = 0").drop("label"), COLUMNS)


@query()
def m08_m11_matrix(spark, sf):
    sets = {"first": COLUMNS[:2], "all": M.FeatureSet([M.Component("e", "csv", prefixes=["e"])]).check().resolve(COLUMNS)}
    return M.run_matrix(samples(spark, sf), sets, ["lr", "en"], FOLDS)


@query()
def k06_k07_run_artefacts(spark, sf):
    """A run saved and read again: its document as a run reader sees it, beside the rows that the loaded
    models of a fold score as the saved predictions say."""
    path = new_path(spark, "run")
    df = samples(spark, sf)
    scored, models = M.nested_cv(df, COLUMNS, FOLDS)
    runs.save_run(path, "20240102_030405", "lr", "e", models, COLUMNS, scored, df)
    _, names, loaded, kept = runs.load_run(spark, path)
    again = None
    for outer in FOLDS:
        ours = [m for (o, _), m in loaded.items() if o == outer]
        one = M.score_external(ours, df.where(F.col("fold") == outer), names).select("row_id", F.col("prob").alias("again"))
        again = one if again is None else again.unionByName(one)
    same = kept.join(again, "row_id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("prob") - F.col("again")) < 1e-12).alias("same"))
    auc = F.col("cv_summary")["roc_auc"]["mean"]
    return read_runs(spark, f"{path}/results").select("model_key", "features_key", F.round(auc, 6).alias("auc_mean")).join(F.broadcast(same))  # one row each
