"""Operators that SQL can't state, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import graph as G
from strandline.operators import modelling as M
from strandline.operators import order, sampling, similarity, tensors
from strandline.operators import statistics as X


def ham(a, b):
    return sum(x != y for x, y in zip(a, b))


def test_context_clusters(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(70):
        pep = "".join(rng.choice(list("AC"), 9))
        rows.append(("".join(rng.choice(list("ACDEF"), 5)) + pep + "".join(rng.choice(list("ACDEF"), 5)), pep))
    rows = sorted(set(rows))
    got = {r.node: r.component for r in G.context_clusters(spark.createDataFrame(rows, "context string, peptide string"), distance=3).collect()}
    root = {c: c for c, _ in rows}
    # components of peptides at most one apart come first: they lift to all their windows
    near = {p: {q for _, q in rows if ham(p, q) <= 1} for _, p in rows}

    def closure(p):
        seen, todo = {p}, [p]
        while todo:
            for q in near[todo.pop()] - seen:
                seen.add(q)
                todo.append(q)
        return seen

    groups = {p: closure(p) for _, p in rows}
    changed = True
    while changed:
        changed = False
        for a, p in rows:
            for b, q in rows:
                if ham(a, b) <= 3 or q in groups[p] or a[:5] == b[:5] or a[-5:] == b[-5:]:
                    low = min(root[a], root[b])
                    if root[a] != low or root[b] != low:
                        root[a] = root[b] = low
                        changed = True
    assert got == root


def test_folds_hold_whole_clusters(spark):
    rows = [(i, f"c{i % 37 if i < 150 else i}") for i in range(400)]
    out = G.assign_folds(spark.createDataFrame(rows, "row_id long, cluster string"), "cluster").collect()
    folds = {}
    for r in out:
        folds.setdefault(r.cluster, set()).add(r.fold)
    assert len(out) == 400 and all(len(f) == 1 for f in folds.values())
    sizes = np.bincount([r.fold for r in out])
    assert sizes.max() - sizes.min() <= 1


def test_bin_matched_counts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(r), int(i % 3 == 0)) for i, r in enumerate(rng.uniform(0, 2, 900) ** 1.0)]
    df = spark.createDataFrame(rows, "row_id long, rank double, label int")
    out = sampling.bin_matched(df.where("label = 1"), df.where("label = 0"), bins=6).collect()
    pos = np.bincount([max(1, int(np.ceil(r * 3))) for _, r, y in rows if y], minlength=7)[1:]
    can = np.bincount([max(1, int(np.ceil(r * 3))) for _, r, y in rows if not y], minlength=7)[1:]
    most = min(int(a * pos.sum() / p) for a, p in zip(can, pos))
    got = np.bincount([r.bin for r in out], minlength=7)[1:]
    assert got.tolist() == [int(most * p / pos.sum()) for p in pos]


def test_random_windows(spark):
    out = [r.window for r in sampling.random_windows(spark, 200, 9, {1: ["L"], 8: ["V", "K"]}, spark.createDataFrame([("ALAAAAAAV",)], "w string")).collect()]
    assert len(set(out)) == 200 and all(len(w) == 9 and w[1] == "L" and w[8] in "VK" for w in out)


def test_best_match(spark):
    rng = np.random.default_rng(3)
    a, b = (["".join(rng.choice(list("ABCD"), 6)) for _ in range(50)] for _ in range(2))
    left = spark.createDataFrame(list(enumerate(a)), "row_id long, s string")
    got = {r.row_id: r.best for r in similarity.best_match(left, spark.createDataFrame([(x,) for x in b], "s string"), "s", 6).collect()}
    for i, x in enumerate(a):
        assert got[i] == pytest.approx(max((6 - ham(x, y)) / 6 for y in b))


@pytest.mark.parametrize("few", [0, 20, 1 << 18])
def test_most_equal(spark, few):
    rng = np.random.default_rng(5)
    a, b = (["".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 9, p=p)) for _ in range(n)] for n, p in ((300, np.r_[0.3, np.full(25, 0.028)]), (400, np.r_[np.full(25, 0.028), 0.3])))
    a += b[:9]
    left, right = spark.createDataFrame([*enumerate(a), (999, None)], "row_id long, s string"), spark.createDataFrame([(x,) for x in [*b, *b, None]], "s string")
    got = {r.row_id: r.best for r in similarity.most_equal(left, right, "s", 9, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "row_id", few).collect()}
    assert got == {r.row_id: r.best for r in similarity.best_match(left, right, "s", 9).collect()}
    assert got == {**{i: max((9 - ham(x, y)) / 9 for y in b) for i, x in enumerate(a)}, 999: None}
    assert similarity.most_equal(left, right.limit(0), "s", 9, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "row_id", few).collect() == []


def test_numbers_and_batches(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    out = order.batched(order.numbered(df, ["k"], "n", start=5), ["n"], 300).collect()
    assert all(r.n == r.k + 5 and r.batch == r.k // 300 for r in out)


def test_components_of_variance(spark):
    x = np.random.default_rng(4).normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, v array<double>")
    want = sorted(np.linalg.eigvalsh(np.cov(x.T)), reverse=True)
    assert tensors.spectrum(df, "v", 5) == pytest.approx(want)
    got = np.array([r.pca for r in tensors.principal_components(df, "v", 2).orderBy("row_id").collect()])
    assert np.var(got, axis=0, ddof=1) == pytest.approx(want[:2]) and abs(got.mean()) < 1e-9


def test_nested_folds_score_every_row_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, int(v > 0), float(v + rng.normal(0, 0.5)), None if i % 10 == 0 else 1.0) for i, v in enumerate(rng.normal(size=150))]
    df = spark.createDataFrame(rows, "row_id long, fold int, label int, a double, b double").cache()
    scored, models = M.nested_cv(df, ["a", "b"], [0, 1, 2])
    out = scored.collect()
    assert sorted(r.row_id for r in out) == list(range(150)) and len(models) == 6
    assert X.auc(scored.join(df.select("row_id", "label"), "row_id"), "prob", "label").first()["auc"] > 0.85
    outside = M.score_external(list(models.values()), df.drop("label"), ["a", "b"]).first()
    assert outside.models == 6
    with pytest.raises(ValueError):
        M.score_external(list(models.values()), df.drop("a"), ["a", "b"])
    assert M.feature_weights(list(models.values()), ["a", "b"])[0][0] == "a"


def test_medians_of_training_rows(spark):
    df = spark.createDataFrame([(1.0, float("nan"), None), (3.0, float("inf"), None), (8.0, 2.0, None)], "a double, b double, c double")
    assert M.medians(df, ["a", "b", "c"]) == {"a": 3.0, "b": 2.0, "c": 0.0}


def test_logistic_odds(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-1.2 * x))).astype(int)
    r = M.univariate_logistic(spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int"), ["x"], "y").first()
    assert r.low < np.exp(1.2) < r.high and r.p < 1e-10


def test_draws_follow_the_keys(spark):
    df = spark.range(4000).select(X.poisson_draw(X.uniform("id")).alias("w"))
    assert df.agg(F.avg("w")).first()[0] == pytest.approx(1, abs=0.06)
    assert df.collect() == spark.range(4000).repartition(7).select("id", X.poisson_draw(X.uniform("id")).alias("w")).orderBy("id").select("w").collect()


def test_folds_by_counts_of_sizes_are_the_greedy_ones(spark):
    rng = random.Random(8)
    for _ in range(300):
        sizes = sorted((rng.choice([1, 1, 1, 2, 3, 7, 40]) for _ in range(rng.randint(1, 60))), reverse=True)
        want = G.balanced_partition([(n, i, i) for i, n in enumerate(sizes)], 4)
        loads, got = [0] * 4, {}
        for n in sorted(set(sizes), reverse=True):
            first = sizes.index(n)
            segments, loads = G.dealing_order(loads, n, sizes.count(n))
            for j in range(sizes.count(n)):
                start, order = [x for x in segments if x[0] <= j][-1]
                got[first + j] = order[(j - start) % len(order)]
        assert got == want
        assert loads == [sum(sizes[i] for i, b in want.items() if b == f) for f in range(4)]


def test_folds_stay_greedy_past_many_clusters(spark):
    rows = spark.range(120_000).selectExpr("id as row_id", "cast(if(id < 3000, id % 40, id) as string) as cluster")
    out = G.assign_folds(rows, "cluster").groupBy("cluster").agg(F.min("fold").alias("fold"), F.min("row_id").alias("m"), F.count("*").alias("n")).collect()
    want = G.balanced_partition([(r.n, r.m, r.cluster) for r in out], 6)
    assert {r.cluster: r.fold for r in out} == want
