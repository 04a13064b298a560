"""Bootstraps against the weights worked out row by row."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import bootstrap as B
from strandline.operators import statistics as X

ROWS = [(None if i == 7 else "x" * (60 if i % 50 == 0 else 0) + str(i * i), None if i % 61 == 0 else float("nan") if i % 67 == 0 else 0.5 if i % 3 else (i * 7919 % 200) / 8, (i * 31 % 40) / 4, None if i % 71 == 0 else int(i % 4 == 1)) for i in range(900)]
REPS = range(95, 125)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "row_id string, a double, b double, y int")


@pytest.fixture(scope="module")
def weights(df):
    """Row, replicate and weight as columns have them."""
    each = df.withColumn("rep", F.explode(F.sequence(F.lit(REPS[0]), F.lit(REPS[-1])))).withColumn("w", X.poisson_draw(X.uniform("rep", "row_id")))
    return {(r.row_id, r.rep): r.w for r in each.collect()}


def order(v):
    return (0, 0) if v is None else (2, 0) if math.isnan(v) else (1, v)


def test_heads():
    for texts in ([b":1", b":7"], [b":" + b"9" * 30], [b":" + b"9" * 80]):
        for reps in ([b"5", b"6"], [b"1234567"]):
            want = [[int(hashlib.md5(r + t).hexdigest()[:8], 16) for r in reps] for t in texts]
            assert B.heads_of(texts, reps).tolist() == want


def test_every_weight():
    cut, p, cuts = 0.0, math.exp(-1), []
    for k in range(12):
        cut, p = cut + p, p / (k + 1)
        cuts.append(cut)
    texts = [f":{i}".encode() for i in range(9000)]
    got = B.Draws(range(9, 14)).weights(texts)
    heads = np.array([[int(hashlib.md5(str(r).encode() + t).hexdigest()[:8], 16) for r in range(9, 14)] for t in texts]) / 2**32
    assert (got == np.searchsorted(cuts, heads, "right")).all()


@pytest.mark.parametrize("task", [200, 50_000_000])
def test_distances(df, weights, task, monkeypatch):
    monkeypatch.setattr(B, "TASK", task)  # the value of most rows is in many parts, or in few
    got = {r.rep: r.ks for r in B.distances(df, "a", "y", "row_id", REPS).collect()}
    assert sorted(got) == list(REPS)
    for rep in REPS:
        size = [sum(weights[r[0], rep] for r in ROWS if r[3] == g) for g in (0, 1)]
        share = lambda v, g: sum(weights[r[0], rep] for r in ROWS if r[3] == g and order(r[1]) <= order(v)) / size[g]
        assert got[rep] == max(abs(share(v, 1) - share(v, 0)) for v in {r[1] for r in ROWS})


def test_areas(df, weights, monkeypatch):
    monkeypatch.setattr(B, "TASK", 2000)
    got = {r.rep: r for r in B.areas(df, ["a", "b"], "y", "row_id", REPS).collect()}
    assert sorted(got) == list(REPS)
    for rep in REPS[::5]:
        for at, name in ((1, "a_a"), (2, "a_b")):
            sides = [[(order(r[at]), weights[r[0], rep]) for r in ROWS if r[3] == g] for g in (0, 1)]
            won = sum(w * x * (1 if u > v else 0.5 if u == v else 0) for u, w in sides[1] for v, x in sides[0])
            assert got[rep][name] == pytest.approx(won / math.prod(sum(w for _, w in s) for s in sides), abs=1e-12)


def test_absent_class(df):
    only = df.where("y = 1")
    assert B.areas(only, ["a"], "y", "row_id", range(3)).select("a_a").distinct().collect() == [(None,)]
    assert X.bootstrap_ks(only, "a", "y", replicates=3).collect() == [(None, None, None)]
    assert B.areas(df.limit(0), ["a"], "y", "row_id", range(3)).count() == 0
    assert X.bootstrap_ks(df.limit(0), "a", "y", replicates=3).collect() == [(None, None, None)]


def test_rows_do_not_grow_with_replicates(df):
    """A row for each distinct value, class and part leaves the draws, whatever the replicates."""
    few, many = (B.drawn(df, ["a", "y"], "row_id", range(n)).count() for n in (2, 400))
    assert few == many < 300
