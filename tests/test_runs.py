"""Run artefacts: what is saved is what is read; strength of the penalty."""

import numpy as np
import pytest

from strandline.operators import modelling as M
from strandline.sources import runs

COLUMNS = ["b", "a"]


@pytest.fixture(scope="module")
def df(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 2))
    y = (x[:, 0] + 0.5 * r.normal(size=120) > 0.3).astype(int)
    rows = [(i, float(x[i, 0]) if i % 19 else None, float(x[i, 1]), int(y[i]), i % 3) for i in range(120)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, label int, fold int")


def test_round_trip(spark, df, tmp_path):
    path = str(tmp_path / "run")
    scored, models = M.nested_cv(df, COLUMNS, [0, 1, 2])
    for _ in range(2):  # a second run replaces the first
        said = runs.save_run(path, "20240102_030405", "lr", "ab", models, COLUMNS, scored, df)
    document, names, loaded, kept = runs.load_run(spark, path)
    assert document == said and names == COLUMNS and sorted(loaded) == sorted(models) and len(models) == 6
    assert [w["name"] for w in document["avg_feature_weights"]] == ["a", "b"]
    want = {r.row_id: r.prob for r in scored.collect()}
    assert {r.row_id: r.prob for r in kept.collect()} == pytest.approx(want) and len(want) == 120
    one = {r.row_id: r.prob for r in M.score(models[0, 1], df).collect()}
    assert {r.row_id: r.prob for r in M.score(loaded[0, 1], df).collect()} == pytest.approx(one)


def test_ranking(spark, tmp_path):
    path = str(tmp_path / "ranked")
    runs.write_ranking(spark.createDataFrame([(2, "en", 0.5), (1, "lr", 0.75)], "place int, model string, auc double"), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ["place\tmodel\tauc", "1\tlr\t0.75", "2\ten\t0.5"]


@pytest.mark.parametrize("strength", [1.0, 0.05])
def test_penalty(spark, df, strength):
    """The gradient of the penalised, class-weighted loss is 0 at the fitted weights."""
    model = M.fit_model(df, COLUMNS, C=strength, tol=1e-12)
    t = model.transform(df).select("features", "label", "weight__").collect()
    x, y, w = np.array([r.features.toArray() for r in t]), np.array([r.label for r in t]), np.array([r.weight__ for r in t])
    fitted = model.stages[-1]
    beta = fitted.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ beta + fitted.intercept)))
    assert np.allclose(strength * x.T @ (w * (y - p)), beta, atol=1e-4)
