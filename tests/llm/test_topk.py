import math

import numpy as np
import pytest

from strandline.llm.topk import block_top, segment_statistics, top_k


def brute(rows, k=5, modulus=50):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, v) in enumerate(ok):
        if i is None or i % modulus:
            continue
        got = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for c, (j, w) in enumerate(ok) if c != q and len(w) == len(v))
        out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(got[:k])]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, np.round(rng.normal(0, 0.3, 24), 1).astype(np.float32).tolist()) for i in range(400)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_odd_rows(spark):
    rows = [(0, [0.5, -0.5]), (0, [0.5, -0.5]), (50, [1.0, 0.0]), (51, [1.0, None]), (52, [float("nan"), 1.0]), (53, None), (54, []), (100, [0.1, 0.2, 0.3]), (None, [0.9, 0.1]), (150, [float("inf"), 0.0]), (60, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, block string, rank int")
    assert sorted(map(tuple, top_k(df).collect()), key=key) == sorted(brute(rows), key=key)
    assert top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("segments", [1, 4, 7])
def test_bounds_hold(segments):
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 100, (30, 20)), rng.normal(0, 100, (40, 20))
    (xm, xd), (ym, yd) = segment_statistics(x, segments), segment_statistics(y, segments)
    assert (xm @ ym.T + xd @ yd.T >= x @ y.T - 1e-6).all()


def test_numbers_beyond_doubles():
    rows = np.array([[2.0**40, 1.0], [2.0**40, 3.0], [1.0, 1.0]])
    got = block_top(rows[:1], np.array([0]), rows, np.arange(3), 1)
    assert [(i, j, int(s)) for i, j, s in got] == [(0, 1, 2**80 + 3)]


def test_large_components_among_many_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) * 2.0 ** int(e) for x, e in zip(rng.integers(-9, 9, 6), rng.integers(0, 300, 6))]) for i in range(300)]
    rows += [(1000 + i, [2.0**200, float(i)] + [0.0] * 4) for i in range(40)] + [(2000, [1e308] * 6)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    limit = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = [(q, r, v, limit(s)) for q, r, v, s in brute([x for x in rows if x[0] != 2000])]
    assert sorted(map(tuple, got)) == sorted(want)
