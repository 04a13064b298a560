"""Every query of the library runs; those with SQL give the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

from strandline.plans.registry import ORACLES, QUERIES, flagship


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if v is not None and v.__class__.__name__ == "Decimal":
        return plain(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).collect()


def test_flagship(spark, sf_dir):
    assert flagship(spark, sf_dir).count() > 0


def test_reads_are_pruned(spark, sf_dir):
    plan = QUERIES["a12_ranges"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan.split("ReadSchema")[1].split("\n")[0]
