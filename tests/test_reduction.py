"""Reductions against numpy."""

import numpy as np
import pytest

from strandline.operators import reduction

N, WIDTH, DEPTH = 60, 4, 3
TRAIN = "row_id % 4 <> 0"


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(5)
    x = r.normal(size=(N, WIDTH, DEPTH)) * np.array([1.0, 3.0, 2.0]) + 0.5
    mask = r.random((N, WIDTH)) < 0.1
    y = (x[:, :, 2].sum(1) > 0).astype(int)
    return x, mask, y


@pytest.fixture(scope="module")
def df(spark, data):
    x, mask, y = data
    rows = [(i, x[i].tolist(), mask[i].tolist(), int(y[i]), i % 3) for i in range(N)]
    return spark.createDataFrame(rows + [(N + 1, None, None, 0, 0)], "row_id long, window array<array<double>>, pad_mask array<boolean>, label int, fold int").repartition(3)


def features(r, df):
    return {x.row_id: x.features for x in r.transform(df).select("row_id", "features").collect()}


def train_rows():
    return np.arange(N) % 4 != 0


def test_flat_components(df, data):
    x, mask, _ = data
    r = reduction.fit(df, TRAIN, "flat", "k", components=3)
    got = features(r, df)
    assert got.pop(N + 1) is None and r.names == ["k_PC001", "k_PC002", "k_PC003"]
    flat = x.reshape(N, -1)
    fit = flat[train_rows() & ~mask.any(1)]
    axes = np.linalg.svd(fit - fit.mean(0), full_matrices=False)[2][:3]
    want = (flat - fit.mean(0)) @ axes.T
    assert np.allclose(np.abs(np.array([got[i] for i in range(N)])), np.abs(want), atol=1e-8)


def test_linear_autoencoder(df, data):
    x, mask, _ = data
    r = reduction.fit(df, TRAIN, "autoencoder", "k", latent=2)
    got = features(r, df)
    assert got.pop(N + 1) is None and r.names[:3] == ["k_pos00_z000", "k_pos00_z001", "k_pos01_z000"] and len(r.names) == WIDTH * 2
    real = x[train_rows()][~mask[train_rows()]]
    axes = np.linalg.svd(real - real.mean(0), full_matrices=False)[2][:2]
    want = ((x - real.mean(0)) @ axes.T).reshape(N, -1)
    assert np.allclose(np.abs(np.array([got[i] for i in range(N)])), np.abs(want), atol=1e-8)


def test_chosen_dimensions(df, data):
    x, mask, _ = data

    def rank(keep):
        sums = np.zeros(DEPTH)
        for i in np.flatnonzero(keep):
            if (~mask[i]).sum() > 1:
                sums += x[i][~mask[i]].var(0)
        return sorted(np.argsort(-sums)[:2].tolist())

    r = reduction.fit(df, TRAIN, "varfold", "k", top_n=2)
    chosen, overall = rank(train_rows()), rank(np.ones(N, bool))
    assert r.dims == chosen and r.jaccard == len({*chosen} & {*overall}) / len({*chosen} | {*overall})
    assert r.names == [f"k_pos{p:02d}_dim{d:03d}" for p in range(WIDTH) for d in chosen]
    got = features(r, df)
    assert np.allclose([got[i] for i in range(N)], x[:, :, chosen].reshape(N, -1))
    best = reduction.fit(df, TRAIN, "dimselect", "k", top_n=1)
    assert best.dims == [2]
    assert np.allclose([features(best, df)[i] for i in range(N)], x[:, :, 2])
    given = reduction.fit(df, TRAIN, "vardims", "k", dims=[2, 0])
    assert np.allclose([features(given, df)[i] for i in range(N)], x[:, :, [2, 0]].reshape(N, -1))


def test_raw_and_pooled(df, data):
    x, mask, _ = data
    raw = reduction.fit(df, TRAIN, "flat_raw", "k")
    assert len(raw.names) == WIDTH * DEPTH and np.allclose(features(raw, df)[3], x[3].ravel())
    pooled = reduction.fit(df, TRAIN, "pool", "k", method="mean_std")
    kept = x[3][~mask[3]] if not mask[3].all() else x[3]
    assert pooled.names[0] == "k_pool-mean_d0001" and pooled.names[-1] == "k_pool-std_d0003"
    assert np.allclose(features(pooled, df)[3], np.concatenate([kept.mean(0), kept.std(0)]))


@pytest.mark.parametrize("mode,options", [("none", {}), ("vardims", {}), ("varfold", {}), ("dimselect", {})])
def test_settings_are_checked(df, mode, options):
    with pytest.raises(ValueError):
        reduction.fit(df, TRAIN, mode, "k", **options)


def test_no_training_rows(df):
    with pytest.raises(ValueError):
        reduction.fit(df, "false", "flat", "k")
