"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import hamming as H
from strandline.operators import rows as R
from strandline.operators import similarity
from strandline.operators.statistics import pearson
from strandline.operators.tensors import imputed_mean
from strandline.plans.base import OBS, PROT, WIN, observations, proteins, table, windows
from strandline.plans.registry import query


@query(f"""WITH {OBS}, e AS (SELECT doc_id, peptide, row_id AS r_id, start FROM obs), j AS (SELECT o.row_id, e.r_id, row_number() OVER (PARTITION BY o.row_id ORDER BY e.r_id) AS rn FROM obs o JOIN e ON o.peptide = e.peptide AND o.doc_id = e.doc_id)
SELECT row_id, r_id FROM j WHERE rn = 1""")
def j01_first_match(spark, sf):
    o = observations(spark, sf)
    e = o.select("peptide", "doc_id", F.col("row_id").alias("r_id"))
    return R.best_per_row(o.select("row_id", "peptide", "doc_id"), e, ["peptide", "doc_id"]).select("row_id", "r_id")


@query(f"WITH {OBS} SELECT a.row_id, b.row_id AS r_id FROM obs a JOIN obs b ON a.peptide = b.peptide AND a.doc_id = b.doc_id AND a.start = b.start")
def j02_j15_exact_match(spark, sf):
    o = observations(spark, sf)
    return o.select("row_id", "peptide", "doc_id", "start").join(o.select("peptide", "doc_id", "start", F.col("row_id").alias("r_id")), ["peptide", "doc_id", "start"]).select("row_id", "r_id")


@query("""SELECT a.c_nationkey AS nation, round(covar_pop(a.m, b.m) / nullif(stddev_pop(a.m) * stddev_pop(b.m), 0), 6) AS r FROM
(SELECT c_nationkey, c_custkey % 97 AS k, avg(c_acctbal) AS m FROM customer GROUP BY 1, 2) a JOIN
(SELECT c_nationkey, c_custkey % 97 AS k, count(*)::DOUBLE AS m FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2) b USING (c_nationkey, k) GROUP BY 1 HAVING count(*) > 5""")
def j03_x26_correlation(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey") % 97)
    a = c.groupBy("c_nationkey", "k").agg(F.avg("c_acctbal").alias("x"))
    b = c.where("c_acctbal > 0").groupBy("c_nationkey", "k").agg(F.count("*").cast("double").alias("y"))
    return a.join(b, ["c_nationkey", "k"]).groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(pearson("x", "y"), 6).alias("r"), F.count("*").alias("n")).where("n > 5").drop("n")


@query(f"WITH {OBS} SELECT o.row_id, p.len FROM (SELECT row_id, CASE WHEN row_id % 9 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id FROM obs) o LEFT JOIN prot p USING (doc_id)")
def j04_left(spark, sf):
    o = observations(spark, sf).select("row_id", F.expr("CASE WHEN row_id % 9 = 0 THEN -doc_id - 1 ELSE doc_id END").alias("doc_id"))
    return o.join(proteins(spark, sf).select("doc_id", "len"), "doc_id", "left").select("row_id", "len")


@query("""WITH b AS (SELECT event_id, event_type, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 50 END AS u FROM events),
f AS (SELECT event_type AS t, u AS v, count(*) AS n FROM b GROUP BY 1, 2) SELECT event_id, n FROM b LEFT JOIN f ON event_type IS NOT DISTINCT FROM t AND u IS NOT DISTINCT FROM v""")
def j05_null_safe_left(spark, sf):
    b = table(spark, sf, "events").select("event_id", "event_type", F.expr("CASE WHEN user_id % 5 <> 0 THEN user_id % 50 END").alias("u"))
    f = b.groupBy("event_type", "u").agg(F.count("*").alias("n"))
    return R.null_safe_join(b, f, ["event_type", "u"]).select("event_id", "n")


@query(f"WITH {OBS}, best AS (SELECT peptide, doc_id, min(rank) AS best FROM obs GROUP BY 1, 2) SELECT row_id, best FROM obs LEFT JOIN best USING (peptide, doc_id)")
def j06_best_rank(spark, sf):
    o = observations(spark, sf)
    best = o.groupBy("peptide", "doc_id").agg(F.min("rank").alias("best"))
    return o.select("row_id", "peptide", "doc_id").join(best, ["peptide", "doc_id"], "left").select("row_id", "best")


@query(f"WITH {OBS} SELECT row_id FROM obs WHERE doc_id IN (SELECT doc_id FROM prot WHERE len > 1000)")
def j07_j12_semi(spark, sf):
    return observations(spark, sf).join(proteins(spark, sf).where("len > 1000").select("doc_id"), "doc_id", "left_semi").select("row_id")


_SETS = f"""WITH {OBS}, pos AS (SELECT DISTINCT peptide, doc_id FROM obs WHERE label = 1), pred AS (SELECT DISTINCT peptide, doc_id FROM obs WHERE rank < 1)"""


@query(_SETS + """ SELECT 'TP' AS kind, peptide, doc_id FROM (SELECT * FROM pred INTERSECT SELECT * FROM pos)
UNION ALL SELECT 'FP', peptide, doc_id FROM (SELECT * FROM pred EXCEPT SELECT * FROM pos) UNION ALL SELECT 'FN', peptide, doc_id FROM (SELECT * FROM pos EXCEPT SELECT * FROM pred)""")
def j08_j09_hits_and_misses(spark, sf):
    o = observations(spark, sf)
    pos, pred = o.where("label = 1").select("peptide", "doc_id").distinct(), o.where("rank < 1").select("peptide", "doc_id").distinct()
    keys = ["peptide", "doc_id"]
    parts = (("TP", pred.join(pos, keys, "left_semi")), ("FP", pred.join(pos, keys, "left_anti")), ("FN", pos.join(pred, keys, "left_anti")))
    out = [d.select(F.lit(k).alias("kind"), *keys) for k, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j10_anti(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT n_name, coalesce(n, 0) AS n FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal < -500 GROUP BY 1) c RIGHT JOIN nation ON c_nationkey = n_nationkey""")
def j11_right(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal < -500").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n = table(spark, sf, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "right").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j13_checked_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return R.checked_join(o, table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@query(f"WITH {WIN} SELECT a.row_id, a.peptide, b.context FROM win a JOIN win b ON a.row_id = b.row_id AND a.peptide = b.peptide")
def j14_u09_keyed_bind(spark, sf):
    """Columns of two tables side by side, by row key instead of position; unequal keys don't meet."""
    w = windows(spark, sf)
    return w.select("row_id", "peptide").join(w.select("row_id", "peptide", "context"), ["row_id", "peptide"])


@query("""WITH f AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS row_id, l_orderkey, l_linenumber, l_quantity FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY row_id) AS o FROM f), p AS (SELECT row_id, l_orderkey, l_linenumber FROM f WHERE l_quantity <= 25),
m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY row_id) AS o FROM p)
SELECT l_orderkey, l_linenumber, o AS occurrence FROM m JOIN n USING (l_orderkey, l_linenumber, o)""")
def j16_ordered_match(spark, sf):
    full = table(spark, sf, "lineitem").withColumn("row_id", F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"))
    return R.ordered_match(full, full.where("l_quantity <= 25"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.col("occurrence").cast("long").alias("occurrence"))


_POINTS = "points AS (SELECT l_orderkey AS k, l_linenumber AS p, min(l_quantity) AS v FROM lineitem GROUP BY 1, 2), spans AS (SELECT o_orderkey AS k, (o_orderkey % 4 + 1)::INT AS start, (o_orderkey % 4 + 1 + o_custkey % 3)::INT AS stop FROM orders)"


@query(f"""WITH {_POINTS}, h AS (SELECT s.k, p.p, p.v FROM spans s JOIN points p ON s.k = p.k AND p.p BETWEEN s.start AND s.stop)
SELECT s.k, count(h.v)::INT AS n, round(avg(h.v), 6) AS mean, string_agg(h.p::VARCHAR || ':' || h.v::INT, ',' ORDER BY h.p) AS listed FROM spans s LEFT JOIN h ON s.k = h.k GROUP BY s.k""")
def j17_interval_lookup(spark, sf):
    pts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("p")).agg(F.min("l_quantity").alias("v"))
    spans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.expr("cast(o_orderkey % 4 + 1 as int)").alias("start"), F.expr("cast(o_orderkey % 4 + 1 + o_custkey % 3 as int)").alias("stop"))
    pts = pts.withColumn("pv", F.struct("p", "v"))
    got = R.intervals_by_array(spans, pts, "k", "p", "pv").withColumn("values", F.coalesce("values", F.array().cast("array<struct<p:int,v:double>>")))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x["v"])
    listed = F.array_join(F.transform("values", lambda x: F.concat(x["p"].cast("string"), F.lit(":"), x["v"].cast("int").cast("string"))), ",")
    return got.select("k", F.size("values").alias("n"), F.round(F.try_divide(total, F.size("values")), 6).alias("mean"), F.nullif(listed, F.lit("")).alias("listed"))


@query(f"""WITH {_POINTS}, h AS (SELECT s.k, list(p.v ORDER BY p.p) AS vs FROM spans s JOIN points p ON s.k = p.k AND p.p BETWEEN s.start AND s.stop GROUP BY s.k)
SELECT k, round((list_sum(vs[1:3]) + greatest(0, 3 - len(vs)) * vs[1]) / 3, 6) AS left_mean, round((list_sum(vs[1:3]) + greatest(0, 3 - len(vs)) * vs[len(vs)]) / 3, 6) AS right_mean FROM h""")
def t15_imputed_region_mean(spark, sf):
    pts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("p")).agg(F.min("l_quantity").alias("v"))
    spans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.expr("cast(o_orderkey % 4 + 1 as int)").alias("start"), F.expr("cast(o_orderkey % 4 + 1 + o_custkey % 3 as int)").alias("stop"))
    got = R.intervals_by_array(spans, pts, "k", "p", "v").where("size(values) > 0")
    return got.select("k", F.round(imputed_mean("values", 3, "left"), 6).alias("left_mean"), F.round(imputed_mean("values", 3, "right"), 6).alias("right_mean"))


@query(f"WITH {OBS}, m AS (SELECT doc_id, max(start) AS top FROM obs GROUP BY 1) SELECT DISTINCT doc_id FROM (SELECT o.doc_id, o.row_id % 45000 AS spot, m.top FROM obs o LEFT JOIN m USING (doc_id)) WHERE spot > top")
def j18_out_of_range(spark, sf):
    o = observations(spark, sf)
    m = o.groupBy("doc_id").agg(F.max("start").alias("top"))
    return o.select("doc_id", (F.col("row_id") % 45000).alias("at")).join(m, "doc_id", "left").where("at > top").select("doc_id").distinct()


_PEPS = f"WITH {OBS}, pep AS (SELECT DISTINCT peptide AS s FROM obs), pairs AS (SELECT a.s AS a, b.s AS b, hamming(a.s, b.s)::INT AS distance FROM pep a JOIN pep b ON a.s < b.s)"


@query(_PEPS + " SELECT a, b, distance FROM pairs WHERE distance <= 1")
def j19_hamming_one(spark, sf):
    return H.close_pairs(observations(spark, sf), "peptide", 9, 1)


_CTXS = f"WITH {WIN}, ctx AS (SELECT DISTINCT context AS s FROM win), pairs AS (SELECT a.s AS a, b.s AS b, hamming(a.s, b.s)::INT AS distance FROM ctx a JOIN ctx b ON a.s < b.s)"


@query(_CTXS + " SELECT a, b, distance FROM pairs WHERE distance <= 4")
def j20_hamming_four(spark, sf):
    return H.close_pairs(windows(spark, sf), "context", 19, 4)


@query(_CTXS + " SELECT distance, count(*) AS pairs, (sum(count(*)) OVER (ORDER BY distance))::BIGINT AS pairs_cum FROM pairs WHERE distance <= 5 GROUP BY distance")
def j21_pair_census(spark, sf):
    return H.census(H.close_pairs(windows(spark, sf), "context", 19, 5))


@query(f"""WITH {WIN}, f AS (SELECT row_id, n_flank, peptide, (doc_id % 6)::INT AS fold FROM win WHERE n_flank <> 'XXXXX')
SELECT a.n_flank, a.row_id AS row_a, b.row_id AS row_b, hamming(a.peptide, b.peptide)::INT AS distance FROM f a JOIN f b ON a.n_flank = b.n_flank AND a.row_id < b.row_id AND a.fold <> b.fold""")
def j22_pairs_in_group(spark, sf):
    w = windows(spark, sf).where("n_flank <> 'XXXXX'").withColumn("fold", (F.col("doc_id") % 6).cast("int"))
    return H.pairs_in_group(w, "n_flank", "peptide", 9).select("n_flank", "row_a", "row_b", "distance")


@query(f"""WITH {OBS}, s AS (SELECT row_id, peptide, doc_id % 2 AS side FROM obs)
SELECT a.row_id, round(max((9 - hamming(a.peptide, b.peptide)) / 9.0::DOUBLE), 9) AS best FROM s a JOIN s b ON a.side = 0 AND b.side = 1 GROUP BY a.row_id""")
def j23_best_similarity(spark, sf):
    s = observations(spark, sf)
    out = similarity.best_match(s.where("doc_id % 2 = 0").select("row_id", "peptide"), s.where("doc_id % 2 = 1").select("peptide"), "peptide", 9)
    return out.select("row_id", F.round("best", 9).alias("best"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j24_lookup(spark, sf):
    names = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name"))  # a fixed list of nations
    return table(spark, sf, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
