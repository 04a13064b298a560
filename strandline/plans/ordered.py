"""Window, order, top-k, set and reshape queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import rows as R
from strandline.plans.base import OBS, WIN, observations, table, windows
from strandline.plans.registry import query


@query(f"WITH {WIN} SELECT row_id, max(greatest(0, 5 - n_real)) OVER (PARTITION BY doc_id)::INT AS n_pad, max(greatest(0, 5 - c_real)) OVER (PARTITION BY doc_id)::INT AS c_pad, greatest(0, 5 - n_real)::INT AS n_pad_row FROM win")
def w02_group_padding(spark, sf):
    """Padding by protein is its largest; the row's own is the other named variant."""
    w = windows(spark, sf)
    g = w.groupBy("doc_id").agg(F.max(F.greatest(F.lit(0), 5 - F.col("n_real"))).alias("n_pad"), F.max(F.greatest(F.lit(0), 5 - F.col("c_real"))).alias("c_pad"))
    return w.join(g, "doc_id").select("row_id", "n_pad", "c_pad", F.greatest(F.lit(0), 5 - F.col("n_real")).alias("n_pad_row"))


@query(f"WITH {WIN}, r AS (SELECT *, row_number() OVER (PARTITION BY n_flank ORDER BY label DESC, row_id) AS rn FROM win) SELECT row_id, n_flank, label FROM r WHERE rn = 1")
def w03_window_dedup(spark, sf):
    return R.window_dedup(windows(spark, sf), key="n_flank").select("row_id", "n_flank", "label")


@query(f"WITH {OBS} SELECT row_id, label FROM obs WHERE doc_id IN (SELECT doc_id FROM obs WHERE label = 1)")
def w04_orphans(spark, sf):
    return R.drop_orphans(observations(spark, sf), "doc_id").select("row_id", "label")


@query("""WITH g AS (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY 1), c AS (SELECT p_brand, row_number() OVER (ORDER BY v DESC, p_brand) AS rank, sum(v) OVER (ORDER BY v DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS cum FROM g)
SELECT p_brand, rank::INT AS rank, round(cum, 6) AS cum, (SELECT min(rank) FROM c WHERE cum >= 0.8)::INT AS needed FROM c""")
def w01_w05_w06_cumulative(spark, sf):
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    w = Window.orderBy(F.desc("v"), "p_brand")  # a row a brand
    whole = Window.partitionBy()
    c = g.withColumns({"rank": F.row_number().over(w), "cum": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("v").over(whole)})
    return c.withColumn("needed", F.min(F.when(F.col("cum") >= 0.8, F.col("rank"))).over(whole)).select("p_brand", "rank", F.round("cum", 6).alias("cum"), "needed")


@query("SELECT user_id, event_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0), 6) AS step FROM events")
def w07_lag_difference(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.round(F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)), 6).alias("step"))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS midrank, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS ecdf FROM part")
def w08_w10_midrank_ecdf(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    ties = F.count("*").over(Window.partitionBy("p_brand", "p_size"))
    return table(spark, sf, "part").select("p_partkey", (F.rank().over(w) + (ties - 1) / 2).alias("midrank"), F.round(F.cume_dist().over(w), 9).alias("ecdf"))


@query(f"""WITH {OBS}, v AS (SELECT row_id, rank * 1.1 AS r FROM obs)
SELECT row_id, CASE WHEN r > 2 THEN NULL ELSE greatest(1, ceil(r * 25 / 2)) END::INT AS bin, CASE WHEN r <= 0.1 THEN 1 WHEN r <= 0.2 THEN 2 WHEN r <= 0.5 THEN 3 WHEN r <= 1 THEN 4 WHEN r <= 1.5 THEN 5 WHEN r <= 2 THEN 6 END::INT AS band FROM v""")
def w11_w12_bins(spark, sf):
    v = observations(spark, sf).select("row_id", (F.col("rank") * 1.1).alias("r"))
    return v.select("row_id", T.closed_bin("r", 25).alias("bin"), T.broken_bin("r", [0, 0.1, 0.2, 0.5, 1, 1.5, 2]).cast("int").alias("band"))


@query(f"WITH {OBS} SELECT doc_id, count(*) AS n, min(row_id) AS first FROM obs GROUP BY 1 ORDER BY n DESC, first LIMIT 40")
def o01_o02_top(spark, sf):
    return observations(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("row_id").alias("first")).orderBy(F.desc("n"), "first").limit(40)


@query(f"""WITH {OBS}, t AS (SELECT *, CASE WHEN rank < 0.5 THEN 'high' WHEN rank < 1 THEN 'mid' ELSE 'low' END AS tier FROM obs), r AS (SELECT *, row_number() OVER (PARTITION BY lang, tier ORDER BY len DESC, row_id) AS rn FROM t)
SELECT lang, tier, row_id, len FROM r WHERE rn = 1""")
def o03_best_by_tier(spark, sf):
    t = observations(spark, sf).withColumn("tier", F.when(F.col("rank") < 0.5, "high").when(F.col("rank") < 1, "mid").otherwise("low"))
    return R.first_by(t, ["lang", "tier"], F.desc("len"), "row_id").select("lang", "tier", "row_id", "len")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_type, event_id FROM r WHERE rn = 1")
def o04_latest(spark, sf):
    return R.first_by(table(spark, sf, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def u01_union(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def u02_u03_sets(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    both = c.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))
    only = c.select(F.col("c_nationkey").alias("k")).subtract(s.where("s_acctbal > 5000").select("s_nationkey"))
    return both.select(F.lit("both").alias("kind"), "k").union(only.select(F.lit("customers"), "k"))


@query("SELECT p_size > 25 AS big, p_retailprice > 1000 AS dear, contains(p_type, 'STEEL') AS steel, count(*) AS n FROM part GROUP BY 1, 2, 3")
def u04_regions(spark, sf):
    return table(spark, sf, "part").groupBy((F.col("p_size") > 25).alias("big"), (F.col("p_retailprice") > 1000).alias("dear"), F.col("p_type").contains("STEEL").alias("steel")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT c_nationkey AS k, list(c_custkey ORDER BY c_acctbal DESC, c_custkey)[1:10] AS a, list(c_custkey ORDER BY c_custkey)[1:10] AS b FROM customer GROUP BY 1)
SELECT k, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 9) AS jaccard FROM t""")
def u05_top_jaccard(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v"))
    a = c.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "i"))).where("rn <= 10").groupBy("k").agg(F.collect_set("i").alias("a"))
    b = c.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("i"))).where("rn <= 10").groupBy("k").agg(F.collect_set("i").alias("b"))
    return a.join(b, "k").select("k", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 9).alias("jaccard"))


@query("SELECT vec_id, unnest(range(0, 8))::INT AS slot, unnest(embedding[1:8])::DOUBLE AS v FROM embeddings")
def u08_unnest(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("slot", "v")).withColumn("v", F.col("v").cast("double"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def u10_distinct(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()
