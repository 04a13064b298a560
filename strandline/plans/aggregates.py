"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.sequence import RESIDUES
from strandline.operators import rows as R
from strandline.plans.base import OBS, PROT, WIN, observations, proteins, table, windows
from strandline.plans.registry import query


@query(f"WITH {OBS} SELECT source, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 9) AS share FROM obs GROUP BY source")
def a01_shares(spark, sf):
    g = observations(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))  # a row a source


@query(f"WITH {OBS} SELECT lang, count(DISTINCT peptide) AS peptides, count(DISTINCT source) AS sources FROM obs GROUP BY lang")
def a02_distinct_counts(spark, sf):
    return observations(spark, sf).groupBy("lang").agg(F.count_distinct("peptide").alias("peptides"), F.count_distinct("source").alias("sources"))


@query("SELECT event_type, (count(DISTINCT u) + max(CASE WHEN u IS NULL THEN 1 ELSE 0 END))::BIGINT AS n FROM (SELECT event_type, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS u FROM events) GROUP BY 1")
def a03_distinct_with_null(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.expr("CASE WHEN user_id % 3 <> 0 THEN user_id END").alias("u"))
    return e.groupBy("event_type").agg((F.count_distinct("u") + F.max(F.col("u").isNull().cast("int"))).alias("n"))


@query(f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY peptide, lang ORDER BY row_id) AS rn FROM obs) SELECT row_id, peptide, lang FROM r WHERE rn = 1")
def a04_distinct_on(spark, sf):
    return R.first_by(observations(spark, sf), ["peptide", "lang"], "row_id").select("row_id", "peptide", "lang")


@query("""SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(v, event_id) FILTER (WHERE v IS NOT NULL) AS v FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN value END AS v FROM events) GROUP BY user_id""")
def a05_first_values(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr("CASE WHEN event_id % 2 = 0 THEN value END").alias("v"))
    return R.first_values(e, ["user_id"], "event_id")


@query(f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, row_id) AS rn FROM obs) SELECT doc_id, row_id, rank FROM r WHERE rn = 1")
def a06_least_of_group(spark, sf):
    return R.first_by(observations(spark, sf), ["doc_id"], "rank", "row_id").select("doc_id", "row_id", "rank")


@query(f"""WITH {OBS} SELECT label, count(*) AS n, round(median(rank), 6) AS median, round(avg(rank), 6) AS mean, round(stddev_samp(rank), 6) AS sd,
round(quantile_cont(rank, 0.25), 6) AS q25, round(quantile_cont(rank, 0.75), 6) AS q75 FROM obs GROUP BY label""")
def a07_summary(spark, sf):
    pct = lambda p: F.round(F.percentile("rank", F.lit(p)), 6)
    return observations(spark, sf).groupBy("label").agg(F.count("*").alias("n"), pct(0.5).alias("median"), F.round(F.avg("rank"), 6).alias("mean"), F.round(F.stddev_samp("rank"), 6).alias("sd"), pct(0.25).alias("q25"), pct(0.75).alias("q75"))


_A08 = " UNION ALL ".join(f"SELECT 'N{i}' AS position, count(*) FILTER (WHERE n_real < {i})::BIGINT AS missing FROM win" for i in range(1, 6))


@query(f"WITH {WIN}, m AS ({_A08}) SELECT * FROM m WHERE missing > 0")
def a08_u06_missing_by_position(spark, sf):
    one = windows(spark, sf).agg(*[F.count_if(F.col("n_real") < i).alias(f"N{i}") for i in range(1, 6)])
    return one.unpivot([], [f"N{i}" for i in range(1, 6)], "position", "missing").where("missing > 0")


@query(f"""WITH {OBS}, l AS (SELECT label, unnest(['L', 'K', 'A']) AS symbol, unnest([contains(peptide, 'L')::INT, contains(peptide, 'K')::INT, contains(peptide, 'A')::INT]) AS hit FROM obs)
SELECT symbol, round(avg(hit) FILTER (WHERE label = 0), 9) AS label_0, round(avg(hit) FILTER (WHERE label = 1), 9) AS label_1, round(avg(hit) FILTER (WHERE label = 1) - avg(hit) FILTER (WHERE label = 0), 9) AS diff FROM l GROUP BY symbol""")
def a09_u07_prevalence(spark, sf):
    o = observations(spark, sf).select("label", *[F.col("peptide").contains(s).cast("int").alias(s) for s in "LKA"])
    wide = o.unpivot(["label"], ["L", "K", "A"], "symbol", "hit").groupBy("symbol").pivot("label", [0, 1]).avg("hit")
    return wide.select("symbol", F.round(F.col("0"), 9).alias("label_0"), F.round(F.col("1"), 9).alias("label_1"), F.round(F.col("1") - F.col("0"), 9).alias("diff"))


@query(f"""WITH {OBS} SELECT (doc_id % 6)::INT AS fold, count(*) AS n, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg, round(100.0::DOUBLE * count(*) FILTER (WHERE label = 1) / count(*), 6) AS pct FROM obs GROUP BY 1""")
def a10_fold_counts(spark, sf):
    o = observations(spark, sf).withColumn("fold", (F.col("doc_id") % 6).cast("int"))
    return o.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), F.round(100.0 * F.count_if(F.col("label") == 1) / F.count("*"), 6).alias("pct"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY 1")
def a11_group_set(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))


@query(f"WITH {OBS} SELECT doc_id, min(start) AS lo, max(stop) AS hi, count(*) AS n FROM obs GROUP BY 1")
def a12_ranges(spark, sf):
    return observations(spark, sf).groupBy("doc_id").agg(F.min("start").alias("lo"), F.max("stop").alias("hi"), F.count("*").alias("n"))


@query(f"""WITH {WIN} SELECT n_flank, count(*) AS n, count(DISTINCT peptide) AS peptides, array_to_string(list_sort(list(DISTINCT (doc_id % 6)::INT)), ',') AS folds, min(label) <> max(label) AS mixed FROM win GROUP BY 1 HAVING count(*) > 1""")
def a13_mechanism_table(spark, sf):
    w = windows(spark, sf).withColumn("fold", (F.col("doc_id") % 6).cast("int"))
    g = w.groupBy("n_flank").agg(F.count("*").alias("n"), F.count_distinct("peptide").alias("peptides"), F.array_join(F.sort_array(F.collect_set("fold")), ",").alias("folds"), (F.min("label") != F.max("label")).alias("mixed"))
    return g.where("n > 1")


@query(f"WITH {OBS}, c AS (SELECT doc_id, count(*) AS w, sum(label) AS p FROM obs GROUP BY 1) SELECT (doc_id % 6)::INT AS fold, sum(w)::BIGINT AS n, max(w)::BIGINT AS largest, round(sum(p) / sum(w)::DOUBLE, 9) AS share FROM c GROUP BY 1")
def a14_a15_cluster_weights(spark, sf):
    c = observations(spark, sf).groupBy("doc_id").agg(F.count("*").alias("w"), F.sum("label").alias("p"))
    return c.groupBy((F.col("doc_id") % 6).cast("int").alias("fold")).agg(F.sum("w").alias("n"), F.max("w").alias("largest"), F.round(F.sum("p") / F.sum("w"), 9).alias("share"))


@query(f"WITH {OBS} SELECT lang, count(*) FILTER (WHERE label = 0) AS l0, count(*) FILTER (WHERE label = 1) AS l1 FROM obs GROUP BY 1")
def a16_crosstab(spark, sf):
    g = observations(spark, sf).groupBy("lang").pivot("label", [0, 1]).count()
    return g.select("lang", F.coalesce("0", F.lit(0)).alias("l0"), F.coalesce("1", F.lit(0)).alias("l1"))


@query(f"""WITH {WIN}, l AS (SELECT label, context, unnest(range(1, 20))::INT AS pos FROM win), s AS (SELECT label, pos, substr(context, pos, 1) AS aa FROM l),
c AS (SELECT label, pos, aa, count(*) AS n FROM s WHERE aa IN ({", ".join(f"'{a}'" for a in RESIDUES)}) GROUP BY 1, 2, 3)
SELECT label, pos, aa, round(n / (sum(n) OVER (PARTITION BY label, pos))::DOUBLE, 9) AS p FROM c""")
def a17_position_probabilities(spark, sf):
    each = windows(spark, sf).select("label", F.posexplode(F.split("context", ""))).select("label", (F.col("pos") + 1).alias("pos"), F.col("col").alias("aa")).where(F.col("aa").isin(*RESIDUES))
    c = each.groupBy("label", "pos", "aa").agg(F.count("*").alias("n"))
    return c.select("label", "pos", "aa", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label", "pos")), 9).alias("p"))


@query(f"""WITH {OBS}, c AS (SELECT substr(peptide, 1, 1) AS aa, count(*) FILTER (WHERE label = 1)::DOUBLE AS n1, count(*) FILTER (WHERE label = 0)::DOUBLE AS n0 FROM obs GROUP BY 1),
t AS (SELECT sum(n1) AS t1, sum(n0) AS t0 FROM c)
SELECT aa, round(log2((n1 / t1 + 1e-6) / (n0 / t0 + 1e-6)), 6) AS log2_ratio, round(((n1 + 0.5) * (t0 - n0 + 0.5)) / ((n0 + 0.5) * (t1 - n1 + 0.5)), 6) AS odds FROM c, t""")
def a18_enrichment(spark, sf):
    c = observations(spark, sf).groupBy(F.substring("peptide", 1, 1).alias("aa")).agg(F.count_if(F.col("label") == 1).cast("double").alias("n1"), F.count_if(F.col("label") == 0).cast("double").alias("n0"))
    w = Window.partitionBy()  # a row a symbol
    c = c.withColumns({"t1": F.sum("n1").over(w), "t0": F.sum("n0").over(w)})
    n1, n0, t1, t0 = (F.col(x) for x in ("n1", "n0", "t1", "t0"))
    return c.select("aa", F.round(F.log2((n1 / t1 + 1e-6) / (n0 / t0 + 1e-6)), 6).alias("log2_ratio"), F.round(((n1 + 0.5) * (t0 - n0 + 0.5)) / ((n0 + 0.5) * (t1 - n1 + 0.5)), 6).alias("odds"))


@query("SELECT event_type, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd FROM (SELECT event_type, user_id % 6 AS fold, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def a19_over_folds(spark, sf):
    f = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 6).alias("fold")).agg(F.avg("value").alias("m"))
    return f.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("sd"))


@query(f"WITH {OBS}, m AS (SELECT row_id, unnest(range(0, 5)) AS model FROM obs) SELECT row_id, round(avg(((row_id * 31 + model * 17) % 1000) / 1000.0::DOUBLE), 9) AS prob FROM m GROUP BY 1")
def a20_model_average(spark, sf):
    m = observations(spark, sf).select("row_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("model"))
    return m.groupBy("row_id").agg(F.round(F.avg(((F.col("row_id") * 31 + F.col("model") * 17) % 1000) / 1000.0), 9).alias("prob"))


@query(f"WITH {WIN} SELECT source, round(avg((n_real < 5)::INT), 9) AS n_short, round(avg((c_real < 5)::INT), 9) AS c_short FROM win GROUP BY 1")
def a21_coverage(spark, sf):
    w = windows(spark, sf)
    return w.groupBy("source").agg(F.round(F.avg((F.col("n_real") < 5).cast("int")), 9).alias("n_short"), F.round(F.avg((F.col("c_real") < 5).cast("int")), 9).alias("c_short"))


@query("""WITH e AS (SELECT event_type, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id FROM events)
SELECT event_type, 'value' AS column_name, count(*) FILTER (WHERE value IS NULL) AS missing, round(100.0::DOUBLE * count(*) FILTER (WHERE value IS NULL) / count(*), 6) AS pct FROM e GROUP BY 1
UNION ALL SELECT event_type, 'user_id', count(*) FILTER (WHERE user_id IS NULL), round(100.0::DOUBLE * count(*) FILTER (WHERE user_id IS NULL) / count(*), 6) FROM e GROUP BY 1""")
def a22_missingness(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.expr("CASE WHEN user_id % 7 <> 0 THEN value END").alias("value"), F.expr("CASE WHEN event_id % 11 <> 0 THEN user_id END").alias("user_id"))
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in ("value", "user_id")])
    long = g.unpivot(["event_type", "n"], ["value", "user_id"], "column_name", "missing")
    return long.select("event_type", "column_name", "missing", F.round(100.0 * F.col("missing") / F.col("n"), 6).alias("pct"))


_SIZE_BIN = "CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 100 THEN '11-100' ELSE '>100' END"


@query(f"WITH {OBS}, c AS (SELECT peptide, count(*) AS n FROM obs GROUP BY 1) SELECT {_SIZE_BIN} AS size_bin, count(*) AS clusters, sum(n)::BIGINT AS members FROM c GROUP BY 1")
def a23_named_bins(spark, sf):
    c = observations(spark, sf).groupBy("peptide").agg(F.count("*").alias("n"))
    return c.groupBy(F.expr(_SIZE_BIN).alias("size_bin")).agg(F.count("*").alias("clusters"), F.sum("n").alias("members"))


@query(f"WITH {OBS}, c AS (SELECT peptide, count(*) AS n FROM obs GROUP BY 1) SELECT n AS occurrences, count(*) AS peptides FROM c GROUP BY 1")
def a24_counts_of_counts(spark, sf):
    return observations(spark, sf).groupBy("peptide").agg(F.count("*").alias("occurrences")).groupBy("occurrences").agg(F.count("*").alias("peptides"))


@query(f"""WITH {WIN} SELECT count(*) AS n, (count(*) - count(DISTINCT (peptide, doc_id, start)))::BIGINT AS exact_copies, (count(DISTINCT (peptide, doc_id, start)) - count(DISTINCT (peptide, doc_id)))::BIGINT AS positional,
(count(DISTINCT (peptide, context)) - count(DISTINCT peptide))::BIGINT AS context_variants FROM win""")
def a25_duplicate_taxonomy(spark, sf):
    w = windows(spark, sf)
    d = lambda *c: F.count_distinct(F.struct(*c))
    a, b = d("peptide", "doc_id", "start"), d("peptide", "doc_id")
    return w.agg(F.count("*").alias("n"), (F.count("*") - a).alias("exact_copies"), (a - b).alias("positional"), (d("peptide", "context") - F.count_distinct("peptide")).alias("context_variants"))


@query(f"""WITH {WIN}, c AS (SELECT peptide, context, count(DISTINCT label) AS labels FROM win GROUP BY 1, 2), p AS (SELECT peptide, count(DISTINCT label) AS labels FROM win GROUP BY 1)
SELECT bool_and(c.labels = 1) AS explained, count(DISTINCT peptide) AS peptides FROM (SELECT peptide, bool_and(labels = 1) AS labels_ok, max(labels) AS m FROM c GROUP BY 1) x JOIN p USING (peptide), LATERAL (SELECT CASE WHEN x.labels_ok THEN 1 ELSE 2 END AS labels) c WHERE p.labels > 1 GROUP BY x.labels_ok""")
def a26_mixed_labels(spark, sf):
    w = windows(spark, sf)
    by_context = w.groupBy("peptide", "context").agg(F.count_distinct("label").alias("labels"))
    mixed = w.groupBy("peptide").agg(F.count_distinct("label").alias("all")).where("all > 1")
    per = by_context.groupBy("peptide").agg(F.bool_and(F.col("labels") == 1).alias("explained")).join(mixed, "peptide")
    return per.groupBy("explained").agg(F.count("*").alias("peptides"))


_A27 = " UNION ALL ".join(f"""SELECT '{k}' AS key, count(*) AS units, sum(n)::BIGINT AS rows, count(*) FILTER (WHERE peps > 1) AS shared, count(*) FILTER (WHERE folds > 1) AS cross_fold, count(*) FILTER (WHERE held AND train) AS held_out
FROM (SELECT {e} AS k, count(*) AS n, count(DISTINCT peptide) AS peps, count(DISTINCT fold) AS folds, bool_or(fold = 5) AS held, bool_or(fold < 5) AS train FROM f GROUP BY 1)""" for k, e in (("n", "n_flank"), ("c", "c_flank"), ("pair", "n_flank || ':' || c_flank")))


@query(f"WITH {WIN}, f AS (SELECT *, (doc_id % 6)::INT AS fold FROM win) {_A27}")
def a27_overlap_by_scope(spark, sf):
    w = windows(spark, sf).withColumn("fold", (F.col("doc_id") % 6).cast("int"))
    keys = F.array(*[F.struct(F.lit(n).alias("key"), F.coalesce(v, F.lit("")).alias("k")) for n, v in (("n", F.col("n_flank")), ("c", F.col("c_flank")), ("pair", F.concat_ws(":", "n_flank", "c_flank")))])
    each = w.select("peptide", "fold", F.explode(keys).alias("x")).select("x.*", "peptide", "fold")
    g = each.groupBy("key", "k").agg(F.count("*").alias("n"), F.count_distinct("peptide").alias("peps"), F.count_distinct("fold").alias("folds"), F.bool_or(F.col("fold") == 5).alias("held"), F.bool_or(F.col("fold") < 5).alias("train"))
    return g.groupBy("key").agg(F.count("*").alias("units"), F.sum("n").alias("rows"), F.count_if(F.col("peps") > 1).alias("shared"), F.count_if(F.col("folds") > 1).alias("cross_fold"), F.count_if(F.col("held") & F.col("train")).alias("held_out"))


@query(f"""WITH {OBS}, pos AS (SELECT DISTINCT peptide, doc_id FROM obs WHERE label = 1), pred AS (SELECT DISTINCT peptide, doc_id FROM obs WHERE rank < 1),
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM pred INTERSECT SELECT * FROM pos)) AS tp, (SELECT count(*) FROM pred) AS np, (SELECT count(*) FROM pos) AS no, (SELECT count(*) FROM obs) AS total)
SELECT tp, np - tp AS fp, no - tp AS fn, total - np - (no - tp) AS tn, round(tp / no::DOUBLE, 9) AS sensitivity, round(tp / np::DOUBLE, 9) AS precision, round(2 * tp / (np + no)::DOUBLE, 9) AS f1 FROM c""")
def a28_predictor_rates(spark, sf):
    o = observations(spark, sf)
    g = o.groupBy("peptide", "doc_id").agg(F.max("label").alias("y"), F.min("rank").alias("r"), F.count("*").alias("n"))
    c = g.agg(F.count_if((F.col("y") == 1) & (F.col("r") < 1)).alias("tp"), F.count_if(F.col("r") < 1).alias("np"), F.count_if(F.col("y") == 1).alias("no"), F.sum("n").alias("total"))
    tp, np, no = F.col("tp"), F.col("np"), F.col("no")
    return c.select("tp", (np - tp).alias("fp"), (no - tp).alias("fn"), (F.col("total") - np - (no - tp)).alias("tn"), F.round(tp / no, 9).alias("sensitivity"), F.round(tp / np, 9).alias("precision"), F.round(2 * tp / (np + no), 9).alias("f1"))


@query("""WITH c AS (SELECT * FROM (VALUES (0, 'all', true), (1, 'priced', true), (2, 'open', true)) t(step, stage, x))
SELECT step, stage, CASE step WHEN 0 THEN (SELECT count(*) FROM orders) WHEN 1 THEN (SELECT count(*) FROM orders WHERE o_totalprice > 100000) ELSE (SELECT count(*) FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O') END AS rows FROM c""")
def a29_d14_cascade(spark, sf):
    return R.cascade(table(spark, sf, "orders"), {"all": F.lit(True), "priced": F.col("o_totalprice") > 100000, "open": F.col("o_orderstatus") == "O"})


@query("""SELECT o_orderkey, o_totalprice < 1000 AS too_cheap, o_totalprice > 400000 AS too_dear, o_orderstatus = 'F' AS closed, (o_totalprice < 1000 OR o_totalprice > 400000 OR o_orderstatus = 'F') AS excluded,
CASE WHEN o_totalprice < 1000 THEN 'too_cheap' WHEN o_totalprice > 400000 THEN 'too_dear' WHEN o_orderstatus = 'F' THEN 'closed' END AS reason FROM orders""")
def d13_ledger(spark, sf):
    rules = {"too_cheap": F.col("o_totalprice") < 1000, "too_dear": F.col("o_totalprice") > 400000, "closed": F.col("o_orderstatus") == "F"}
    return R.ledger(table(spark, sf, "orders"), rules).select("o_orderkey", *rules, "excluded", "reason")


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS dim FROM embeddings")
def a30_argmax(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("dim"))
