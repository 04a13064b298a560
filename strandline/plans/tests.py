"""Sampling and statistics queries. Scores are arithmetic of the ids, equal in both engines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import bootstrap, sampling
from strandline.operators import statistics as X
from strandline.operators.curves import compare_rocs
from strandline.plans.base import OBS, observations, table
from strandline.plans.registry import query
from strandline.storage import table_of

_SCORES = """sc AS (SELECT event_id AS row_id, event_type, user_id, (event_type = 'purchase')::INT AS y, value, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS pa,
  (((event_id * 104729) % 1000) / 1000.0::DOUBLE + 0.3::DOUBLE * (event_type = 'purchase')::INT) / 1.3::DOUBLE AS pb, (user_id % 6)::INT AS fold FROM events)"""


def scores(spark, sf):
    e = table(spark, sf, "events")
    y = (F.col("event_type") == "purchase").cast("int")
    return e.select(F.col("event_id").alias("row_id"), "event_type", "user_id", y.alias("y"), "value", ((F.col("event_id") * 7919) % 1000 / F.lit(1000.0)).alias("pa"), (((F.col("event_id") * 104729) % 1000 / F.lit(1000.0) + F.lit(0.3) * y) / F.lit(1.3)).alias("pb"), (F.col("user_id") % 6).cast("int").alias("fold"))


_BIN = "greatest(1, ceil(rank * {n} / 2))::INT"
_PLAN = """, b AS (SELECT label, """ + _BIN.format(n=25) + """ AS bin FROM obs), p AS (SELECT bin, count(*) AS pos FROM b WHERE label = 1 GROUP BY 1), c AS (SELECT bin, count(*) AS av FROM b WHERE label = 0 GROUP BY 1),
j AS (SELECT bin, pos, coalesce(av, 0) AS available, sum(pos) OVER () AS total FROM p LEFT JOIN c USING (bin)), m AS (SELECT *, min(floor(available * total / pos::DOUBLE)) OVER () AS max_n FROM j)
SELECT bin, pos, available, max_n::BIGINT AS max_n, floor(max_n * pos / total::DOUBLE)::BIGINT AS n_sample FROM m"""


@query(f"WITH {OBS}" + _PLAN)
def x01_sampling_plan(spark, sf):
    o = observations(spark, sf).withColumn("bin", T.closed_bin("rank", 25))
    return sampling.plan(o.where("label = 1"), o.where("label = 0")).select("bin", "pos", "available", "max_n", "n_sample")


@query(f"""WITH {OBS}, b AS (SELECT row_id, label, {_BIN.format(n=25)} AS bin FROM obs), p AS (SELECT bin, count(*) AS pos FROM b WHERE label = 1 GROUP BY 1), c AS (SELECT bin, count(*) AS av FROM b WHERE label = 0 GROUP BY 1),
j AS (SELECT bin, pos, coalesce(av, 0) AS available, sum(pos) OVER () AS total FROM p LEFT JOIN c USING (bin)), m AS (SELECT *, min(floor(available * total / pos::DOUBLE)) OVER () AS max_n FROM j),
r AS (SELECT row_id, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('42:' || row_id)) AS rn FROM b WHERE label = 0)
SELECT row_id, r.bin FROM r JOIN m ON r.bin = m.bin WHERE rn <= floor(max_n * pos / total::DOUBLE)""")
def x01_bin_matched_sample(spark, sf):
    o = observations(spark, sf)
    return sampling.bin_matched(o.where("label = 1"), o.where("label = 0")).select("row_id", "bin")


@query(f"""WITH {OBS}, s AS (SELECT unnest(range(5, 51))::INT AS n_bins), b AS (SELECT n_bins, label, greatest(1, ceil(rank * n_bins / 2))::INT AS bin FROM obs, s),
p AS (SELECT n_bins, bin, count(*) AS pos FROM b WHERE label = 1 GROUP BY 1, 2), c AS (SELECT n_bins, bin, count(*) AS av FROM b WHERE label = 0 GROUP BY 1, 2),
j AS (SELECT n_bins, bin, pos, coalesce(av, 0) AS available, sum(pos) OVER (PARTITION BY n_bins) AS total FROM p LEFT JOIN c USING (n_bins, bin)), m AS (SELECT *, min(floor(available * total / pos::DOUBLE)) OVER (PARTITION BY n_bins) AS max_n FROM j)
SELECT n_bins, sum(floor(max_n * pos / total::DOUBLE))::BIGINT AS sampled, arg_min(bin, available * total / pos::DOUBLE * 1000 + bin) AS bottleneck FROM m GROUP BY 1""")
def x02_bin_sweep(spark, sf):
    o = observations(spark, sf).select("label", "rank", F.explode(F.sequence(F.lit(5), F.lit(50))).alias("n_bins"))
    o = o.withColumn("bin", F.greatest(F.lit(1), F.ceil(F.col("rank") * F.col("n_bins") / 2)).cast("int"))
    p = sampling.plan(o.where("label = 1"), o.where("label = 0"), by=["n_bins"])
    return p.groupBy("n_bins").agg(F.sum("n_sample").alias("sampled"), F.min_by("bin", F.col("available") * F.col("total") / F.col("pos") * 1000 + F.col("bin")).alias("bottleneck"))


_VC = """, t AS (SELECT event_type, v, p, n, coalesce(sum(p) OVER (PARTITION BY event_type ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
  sum(p) OVER (PARTITION BY event_type) AS n1, sum(n) OVER (PARTITION BY event_type) AS n0 FROM (SELECT event_type, round(value, 1) AS v, count(*) FILTER (WHERE user_id % 2 = 1) AS p, count(*) FILTER (WHERE user_id % 2 = 0) AS n FROM events GROUP BY 1, 2)),
g AS (SELECT event_type, max(abs((pb + p) / n1::DOUBLE - (nb + n) / n0::DOUBLE)) AS ks, sum(p * (nb + n / 2.0::DOUBLE)) AS u, sum((p + n)::DOUBLE ** 3 - (p + n)) AS t3, max(n1)::DOUBLE AS n1, max(n0)::DOUBLE AS n0 FROM t GROUP BY 1)"""


@query(f"WITH one AS (SELECT 1){_VC} SELECT event_type, round(ks, 6) AS ks, round(u, 3) AS u, round((u - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - t3 / ((n1 + n0) * (n1 + n0 - 1)))), 6) AS z, round(2 * u / (n1 * n0) - 1, 6) AS delta, round(u / (n1 * n0), 6) AS cles FROM g")
def x03_x04_x05_two_sample(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.round("value", 1).alias("value"), (F.col("user_id") % 2).alias("g"))
    t = X.two_sample(e, "value", "g", ["event_type"])
    return t.select("event_type", F.round("ks", 6).alias("ks"), F.round("u", 3).alias("u"), F.round("z", 6).alias("z"), F.round("delta", 6).alias("delta"), F.round("cles", 6).alias("cles"))


@query()
def x06_bootstrap_ks(spark, sf):
    return X.bootstrap_ks(scores(spark, sf), "value", "y", replicates=1000)


@query(f"""WITH {_SCORES}, a AS (SELECT avg(value) FILTER (WHERE y = 1) AS m1, avg(value) FILTER (WHERE y = 0) AS m0, var_samp(value) FILTER (WHERE y = 1) AS v1, var_samp(value) FILTER (WHERE y = 0) AS v0, count(*) FILTER (WHERE y = 1)::DOUBLE AS n1, count(*) FILTER (WHERE y = 0)::DOUBLE AS n0 FROM sc),
s AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS smd FROM a), e AS (SELECT *, sqrt((n1 + n0) / (n1 * n0) + smd * smd / (2 * (n1 + n0))) AS se FROM s)
SELECT round(smd, 6) AS smd, round(se, 6) AS se, round(smd - 1.96 * se, 6) AS low, round(smd + 1.96 * se, 6) AS high FROM e""")
def x07_standardized_difference(spark, sf):
    return X.standardized_difference(scores(spark, sf), "value", "y").select(*[F.round(c, 6).alias(c) for c in ("smd", "se", "low", "high")])


@query()
def x08_univariate_logistic(spark, sf):
    from strandline.operators.modelling import univariate_logistic

    return univariate_logistic(scores(spark, sf), ["pa", "pb", "value"], "y")


@query("""WITH o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS o FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(o) AS ra FROM o GROUP BY 1), c AS (SELECT b, sum(o) AS rb FROM o GROUP BY 1), n AS (SELECT sum(o) AS n FROM o),
x AS (SELECT sum((coalesce(o.o, 0) - ra * rb / n) ** 2 / (ra * rb / n)) AS chi2 FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN o ON o.a = r.a AND o.b = c.b)
SELECT round(chi2, 6) AS chi2, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS df, round(sqrt(chi2 / (n * (least((SELECT count(*) FROM r), (SELECT count(*) FROM c)) - 1))), 6) AS cramers_v, n::BIGINT AS n FROM x, n""")
def x09_chi_square(spark, sf):
    c = X.chi_square(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return c.select(F.round("chi2", 6).alias("chi2"), "df", F.round("cramers_v", 6).alias("cramers_v"), "n")


@query()
def x10_fisher(spark, sf):
    t = scores(spark, sf).groupBy("fold").agg(*[F.count_if(c).alias(n) for n, c in (("a", (F.col("y") == 1) & (F.col("pa") > 0.5)), ("b", (F.col("y") == 1) & (F.col("pa") <= 0.5)), ("c", (F.col("y") == 0) & (F.col("pa") > 0.5)), ("d", (F.col("y") == 0) & (F.col("pa") <= 0.5)))])

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([X.fisher_p(*map(int, x)) for x in zip(a, b, c, d)])

    return t.withColumn("p", F.round(p("a", "b", "c", "d"), 9))


_P = "p AS (SELECT p_partkey AS k, p_brand AS b, ((p_partkey * 7919) % 10007 + 1) / 20014.0::DOUBLE AS p FROM part)"


@query(f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p, k) AS r, count(*) OVER (PARTITION BY b) AS m FROM p)
SELECT k, round(least(1, min(p * m / r) OVER (PARTITION BY b ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS bh, round(least(1, max(p * (m - r + 1)) OVER (PARTITION BY b ORDER BY r ROWS UNBOUNDED PRECEDING)), 9) AS holm,
CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS code FROM r""")
def x11_x12_x13_adjusted(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("b"), (((F.col("p_partkey") * 7919) % 10007 + 1) / F.lit(20014.0)).alias("p"))
    bh = X.adjust(p, "p", "bh", ["b"], "k").withColumnRenamed("p_adj", "bh")
    return X.adjust(bh, "p", "holm", ["b"], "k").select("k", F.round("bh", 9).alias("bh"), F.round("p_adj", 9).alias("holm"), T.stars("p").alias("code"))


_AUC = "SELECT fold, round(sum(p * (nb + n / 2.0::DOUBLE)) / (sum(p) * sum(n)), 9) AS auc FROM (SELECT fold, v, p, n, coalesce(sum(n) OVER (PARTITION BY fold ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM (SELECT fold, pb AS v, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM sc GROUP BY 1, 2)) GROUP BY 1"


@query(f"WITH {_SCORES} {_AUC}")
def x14_x28_auc(spark, sf):
    return X.auc(scores(spark, sf), "pb", "y", ["fold"]).select("fold", F.round("auc", 9).alias("auc"))


_V = "(SELECT row_id, y, CASE WHEN y = 1 THEN (nb + n / 2.0::DOUBLE) / (SELECT sum(1 - y) FROM sc) ELSE ((SELECT sum(y) FROM sc) - pbl - p / 2.0::DOUBLE) / (SELECT sum(y) FROM sc) END AS v FROM sc JOIN (SELECT v, p, n, coalesce(sum(p) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pbl, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM (SELECT {s} AS v, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM sc GROUP BY 1)) t ON sc.{s} = t.v)"


@query(f"""WITH {_SCORES}, a AS {_V.format(s='pa')}, b AS {_V.format(s='pb')}, g AS (SELECT a.y, avg(a.v) AS ma, avg(b.v) AS mb, (var_samp(a.v) + var_samp(b.v) - 2 * covar_samp(a.v, b.v)) / count(*) AS var FROM a JOIN b USING (row_id) GROUP BY 1)
SELECT round(max(ma) FILTER (WHERE y = 1), 8) AS auc_a, round(max(mb) FILTER (WHERE y = 1), 8) AS auc_b, round(sum(var) * 1e6, 4) AS variance_e6, round((max(ma) FILTER (WHERE y = 1) - max(mb) FILTER (WHERE y = 1)) / sqrt(sum(var)), 4) AS z FROM g""")
def x15_delong(spark, sf):
    d = X.delong(scores(spark, sf), "pa", "pb", "y")
    return d.select(F.round("auc_a", 8).alias("auc_a"), F.round("auc_b", 8).alias("auc_b"), F.round(F.col("variance") * 1e6, 4).alias("variance_e6"), F.round("z", 4).alias("z"))


@query()
def x16_paired_bootstrap(spark, sf):
    """Poisson bootstrap of the difference of two areas."""
    d = bootstrap.areas(scores(spark, sf), ["pa", "pb"], "y", "row_id", range(1, 1001)).withColumn("d", F.col("a_pa") - F.col("a_pb"))
    tail = F.least(F.count_if(F.col("d") <= 0), F.count_if(F.col("d") >= 0))
    return d.agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.least(F.lit(1.0), 2.0 * (tail + 1) / (F.count("*") + 1)).alias("p"))


@query()
def x17_corrected_t(spark, sf):
    s = scores(spark, sf)
    rows = X.auc(s, "pa", "y", ["fold"]).select("fold", F.col("auc").alias("a")).join(X.auc(s, "pb", "y", ["fold"]).select("fold", F.col("auc").alias("b")), "fold").orderBy("fold").collect()  # a row a fold
    t, p = X.corrected_t([r["a"] for r in rows], [r["b"] for r in rows])
    return spark.createDataFrame([(t, 5.0, p)], "t double, df double, p double")


@query(f"WITH {_SCORES} SELECT row_id, round(pa, 6) AS prob FROM sc")
def x18_out_of_fold(spark, sf):
    """Scores kept as one array a fold return to their rows by place within the fold."""
    from strandline.operators.modelling import rebuild_out_of_fold

    s = scores(spark, sf)
    runs = s.groupBy("fold").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_id", "pa", "y"))), lambda x: F.struct(x["pa"].alias("y_prob"), x["y"].alias("y_true"))).alias("scores"))
    return rebuild_out_of_fold(s.select("row_id", "fold", "y"), runs).select("row_id", F.round("prob", 6).alias("prob"))


@query(f"""WITH {_SCORES}, c AS (SELECT fold, count(*) FILTER (WHERE y = 1 AND pb >= 0.5)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND pb >= 0.5)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND pb < 0.5)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND pb < 0.5)::DOUBLE AS tn FROM sc GROUP BY 1)
SELECT fold, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 9) AS mcc, round(tp / (tp + fn), 9) AS sensitivity, round(tn / (tn + fp), 9) AS specificity, round(tp / nullif(tp + fp, 0), 9) AS ppv, round(tn / nullif(tn + fn, 0), 9) AS npv FROM c""")
def x19_metrics(spark, sf):
    m = X.confusion_metrics(scores(spark, sf), "pb", "y", ["fold"])
    return m.select("fold", *[F.round(c, 9).alias(c) for c in m.columns if c != "fold"])


@query(f"""WITH {_SCORES}, e AS (SELECT fold, pb AS v, sum(y) AS p, count(*) AS c FROM sc GROUP BY 1, 2), r AS (SELECT fold, p, sum(p) OVER w AS tp, sum(c) OVER w AS seen FROM e WINDOW w AS (PARTITION BY fold ORDER BY v DESC))
SELECT fold, round(sum(p * tp / seen::DOUBLE) / sum(p), 9) AS average_precision FROM r GROUP BY 1""")
def x19_average_precision(spark, sf):
    return X.average_precision(scores(spark, sf), "pb", "y", ["fold"]).select("fold", F.round("average_precision", 9).alias("average_precision"))


_ROC = """, e AS (SELECT m, fold, v, sum(y) AS p, sum(1 - y) AS n FROM (SELECT 'a' AS m, fold, pa AS v, y FROM sc UNION ALL SELECT 'b', fold, pb, y FROM sc) GROUP BY 1, 2, 3),
t AS (SELECT m, fold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY m, fold) AS np, sum(n) OVER (PARTITION BY m, fold) AS nn FROM e WINDOW w AS (PARTITION BY m, fold ORDER BY v DESC)),
q AS (SELECT m, fold, fp, np, nn, min(tp) AS lo, max(tp) AS hi FROM (SELECT * FROM t UNION ALL SELECT DISTINCT m, fold, 0, 0, np, nn FROM t) GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT *, lead(fp) OVER w AS fp2, lead(lo) OVER w AS lo2 FROM q WINDOW w AS (PARTITION BY m, fold ORDER BY fp)),
g AS (SELECT m, fold, i, (hi + coalesce((lo2 - hi) * (i * nn / 1000.0::DOUBLE - fp) / (fp2 - fp)::DOUBLE, 0)) / np::DOUBLE AS h FROM s JOIN range(11, 990) r(i) ON i * nn >= 1000 * fp AND i * nn < 1000 * coalesce(fp2, 1000000000000)),
u AS (SELECT m, fold, sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS auc FROM (SELECT m, fold, p, n, coalesce(sum(n) OVER (PARTITION BY m, fold ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM e) GROUP BY 1, 2),
d AS (SELECT a.fold, a.i, a.h - b.h AS gap, x.auc - y.auc AS delta FROM g a JOIN g b ON a.m = 'a' AND b.m = 'b' AND a.fold = b.fold AND a.i = b.i JOIN u x ON x.fold = a.fold AND x.m = 'a' JOIN u y ON y.fold = a.fold AND y.m = 'b'),
f AS (SELECT fold, sum((sign(gap) <> sign(before))::INT) AS crossings FROM (SELECT fold, gap, lag(gap) OVER (PARTITION BY fold ORDER BY i) AS before FROM d WHERE abs(gap) >= 0.002) WHERE before IS NOT NULL GROUP BY 1)
SELECT d.fold, coalesce(max(f.crossings), 0)::INT AS crossings, round(max(abs(gap)), 9) AS max_gap, CASE WHEN coalesce(max(f.crossings), 0) > 0 THEN 'crossing' WHEN max(abs(gap)) < 0.002 THEN 'near_identical' ELSE 'clean' END AS verdict,
  round(count(*) FILTER (WHERE abs(gap) >= 0.002 AND delta <> 0 AND sign(gap) <> sign(delta)) / 1000.0::DOUBLE, 4) AS disagree_range, round(coalesce(max(abs(gap)) FILTER (WHERE abs(gap) >= 0.002 AND delta <> 0 AND sign(gap) <> sign(delta)), 0), 9) AS max_flip
FROM d LEFT JOIN f ON f.fold = d.fold GROUP BY d.fold"""


@query(f"WITH {_SCORES}{_ROC}")
def x20_roc_crossings(spark, sf):
    out = compare_rocs(scores(spark, sf), "pa", "pb", "y", ["fold"])
    return out.select("fold", "crossings", F.round("max_gap", 9).alias("max_gap"), "verdict", "disagree_range", F.round("max_flip", 9).alias("max_flip"))


@query()
def x20_roc_tiers(spark, sf):
    return compare_rocs(scores(spark, sf), "pa", "pb", "y", ["fold"])


@query(f"WITH {_SCORES} SELECT least(9, floor(pb * 10))::INT AS bin, count(*) AS n, round(avg(pb), 9) AS mean_score, round(avg(y), 9) AS share FROM sc GROUP BY 1")
def x21_calibration(spark, sf):
    return X.calibration(scores(spark, sf), "pb", "y").select("bin", "n", F.round("mean_score", 9).alias("mean_score"), F.round("share", 9).alias("share"))


@query(f"""WITH {_SCORES}, e AS (SELECT fold, pb AS v, sum(y) AS p, count(*) AS c FROM sc GROUP BY 1, 2), r AS (SELECT fold, v, sum(p) OVER w AS tp, sum(c) OVER w AS seen, sum(p) OVER (PARTITION BY fold) AS np FROM e WINDOW w AS (PARTITION BY fold ORDER BY v DESC))
SELECT fold, round(v, 9) AS threshold, round(tp / seen::DOUBLE, 9) AS precision, round(tp / np::DOUBLE, 9) AS recall FROM r""")
def x21_pr_curve(spark, sf):
    return X.pr_curve(scores(spark, sf), "pb", "y", ["fold"]).select("fold", *[F.round(c, 9).alias(c) for c in ("threshold", "precision", "recall")])


@query(f"WITH {_SCORES} SELECT y, least(49, floor(pa * 50))::INT AS bin, count(*) AS n FROM sc GROUP BY 1, 2")
def x21_score_distribution(spark, sf):
    return scores(spark, sf).groupBy("y", F.least(F.lit(49), F.floor(F.col("pa") * 50)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PROFILE = """, a AS (SELECT (doc_id % 6)::INT AS fold, i::INT - 1 AS pos, substr(peptide, i, 1) AS aa FROM (SELECT doc_id, peptide, unnest(range(1, 10)) AS i FROM obs)), k AS (SELECT fold, pos, aa, count(*) AS n FROM a GROUP BY 1, 2, 3),
cells AS (SELECT DISTINCT fold, pos, chr((65 + c)::INT) AS aa FROM k, range(26) t(c)), n AS (SELECT fold, pos, aa, coalesce(n, 0) AS n FROM cells LEFT JOIN k USING (fold, pos, aa))"""


def fold_profiles(spark, sf):
    return X.profile_counts(observations(spark, sf).select((F.col("doc_id") % 6).cast("int").alias("fold"), "peptide"), "peptide", "fold")


@query(f"""WITH {OBS}{_PROFILE}, t AS (SELECT *, sum(n) OVER (PARTITION BY fold, pos) AS r, sum(n) OVER (PARTITION BY pos, aa) AS an FROM n), u AS (SELECT *, sum(an) OVER (PARTITION BY fold, pos) AS ar FROM t),
v AS (SELECT fold, pos, CASE WHEN n > 0 THEN n / r::DOUBLE * log2(n / r::DOUBLE) ELSE 0 END AS h, (n + 0.5::DOUBLE) / (r + 13) AS p, (an + 0.5::DOUBLE) / (ar + 13) AS q FROM u)
SELECT fold, round(avg(h), 6) AS entropy, round(avg(kl), 6) AS kl FROM (SELECT fold, pos, -sum(h) AS h, sum(p * log2(p / q)) AS kl FROM v GROUP BY 1, 2) GROUP BY 1""")
def x22_fold_divergence(spark, sf):
    """Entropy and divergence by position with the survey's pseudocount, then their means."""
    return X.profile_divergence(fold_profiles(spark, sf), "fold", _LETTERS).select("fold", F.round("entropy", 6).alias("entropy"), F.round("kl", 6).alias("kl"))


@query(f"""WITH {OBS}{_PROFILE}, f AS (SELECT fold, pos, aa, n / sum(n) OVER (PARTITION BY fold, pos)::DOUBLE AS f FROM n)
SELECT x.fold AS a, y.fold AS b, round(corr(x.f, y.f), 6) AS pcc FROM f x JOIN f y ON x.pos = y.pos AND x.aa = y.aa AND x.fold < y.fold GROUP BY 1, 2""")
def x22_profile_correlation(spark, sf):
    return X.profile_correlation(fold_profiles(spark, sf), "fold", 9 * len(_LETTERS)).select("a", "b", F.round("pcc", 6).alias("pcc"))


@query()
def g09_linkage_order(spark, sf):
    """The folds in the order of an average-linkage tree on 1 - correlation of their profiles."""
    import numpy as np

    rows = X.profile_correlation(fold_profiles(spark, sf), "fold", 9 * len(_LETTERS)).collect()  # a row a pair of folds
    folds = sorted({r[c] for r in rows for c in "ab"})
    d = np.zeros((len(folds), len(folds)))
    for r in rows:
        i, j = folds.index(r["a"]), folds.index(r["b"])
        d[i, j] = d[j, i] = max(0.0, 1 - r["pcc"])
    return spark.createDataFrame(list(enumerate(X.linkage_order(folds, d))), "place int, fold int")


@query(f"""WITH {OBS}, a AS (SELECT (doc_id % 6)::INT AS fold, substr(peptide, i, 1) AS aa FROM (SELECT doc_id, peptide, unnest(range(1, 10)) AS i FROM obs)), s AS (SELECT DISTINCT aa FROM a), f AS (SELECT DISTINCT fold FROM a),
c AS (SELECT f.fold, s.aa, count(a.aa) + 1.0::DOUBLE AS n FROM f CROSS JOIN s LEFT JOIN a ON a.fold = f.fold AND a.aa = s.aa GROUP BY 1, 2), q AS (SELECT aa, sum(n) AS m FROM c GROUP BY 1),
p AS (SELECT fold, aa, n / sum(n) OVER (PARTITION BY fold) AS p, m / sum(m) OVER (PARTITION BY fold) AS q FROM c JOIN q USING (aa)) SELECT fold, round(-sum(p * log2(p)), 6) AS entropy, round(sum(p * log2(p / q)), 6) AS kl FROM p GROUP BY 1""")
def x22_entropy(spark, sf):
    a = observations(spark, sf).select((F.col("doc_id") % 6).cast("int").alias("fold"), F.explode(F.split("peptide", "")).alias("aa"))
    wide = a.groupBy("fold").pivot("aa").count()
    symbols = [c for c in wide.columns if c != "fold"]
    c = wide.na.fill(0).unpivot(["fold"], symbols, "aa", "n").withColumn("n", F.col("n") + 1.0)
    q = c.groupBy("aa").agg(F.sum("n").alias("m"))
    w = Window.partitionBy("fold")
    p = c.join(q, "aa").select("fold", (F.col("n") / F.sum("n").over(w)).alias("p"), (F.col("m") / F.sum("m").over(w)).alias("q"))
    return p.groupBy("fold").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"), F.round(F.sum(F.col("p") * F.log2(F.col("p") / F.col("q"))), 6).alias("kl"))


@query()
def x23_permutation_null(spark, sf):
    o = observations(spark, sf).groupBy(F.col("doc_id").alias("cluster")).agg(F.count("*").alias("n")).withColumn("fold", (F.col("cluster") % 6).cast("int"))
    return X.permuted_shares(o, "cluster", "n", "fold", 1000)


@query()
def x24_two_sample_classifier(spark, sf):
    from strandline.operators.modelling import classifier_two_sample

    return classifier_two_sample(spark, table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 2).cast("int").alias("side")))


#: Fewer than the survey's 1000; see the README.
LOGO_REPLICATES = 200


@query()
def x25_logo_permutation(spark, sf):
    """Jensen-Shannon divergence by position between labels, against permuted labels of whole rows:
    the counts by symbol of one class follow from those of the other and of all rows."""
    o = observations(spark, sf).select("row_id", "peptide", "label").where("label is not null")
    o, _ = table_of(o, "logo")
    drawn = sampling.permuted_ones(o, "label", "row_id", LOGO_REPLICATES).union(o.where("label = 1").select(F.lit(0).alias("rep"), "row_id", "peptide", "label")).select("rep", "peptide")
    letters = F.posexplode(F.split("peptide", "")).alias("pos", "aa")
    ones = drawn.select("rep", letters).groupBy("rep", "pos", "aa").agg(F.count("*").alias("n1"))
    whole = o.select(letters).groupBy("pos", "aa").agg(F.count("*").alias("n")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(LOGO_REPLICATES))))
    each = whole.join(ones, ["rep", "pos", "aa"], "left").select("rep", "pos", "aa", F.coalesce("n1", F.lit(0)).alias("n1"), (F.col("n") - F.coalesce("n1", F.lit(0))).alias("n0"))
    w = Window.partitionBy("rep", "pos")
    p, q = F.col("n1") / F.sum("n1").over(w), F.col("n0") / F.sum("n0").over(w)
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    js = each.withColumn("t", (part(p) + part(q)) / 2).groupBy("rep", "pos").agg(F.sum("t").alias("js"))
    own = js.where("rep = 0").select("pos", F.col("js").alias("observed"))
    return js.where("rep > 0").join(own, "pos").groupBy("pos", "observed").agg(((F.count_if(F.col("js") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(corr(l_discount, l_tax), 6) AS pearson2 FROM lineitem")
def x26_pearson(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(X.pearson("l_quantity", "l_extendedprice"), 6).alias("pearson"), F.round(X.pearson("l_discount", "l_tax"), 6).alias("pearson2"))


def _stop_sql(name, sign, best):
    return f"""SELECT user_id, '{name}' AS metric, coalesce(min(i) FILTER (WHERE i - best >= 5), max(i))::INT AS stop_round, coalesce(min(i) FILTER (WHERE i - best >= 5) - 5, max(best))::INT AS best_round FROM
(SELECT user_id, i, max(CASE WHEN before IS NULL OR v {sign} before THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS best FROM
(SELECT *, {best}(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)) GROUP BY 1"""


@query(f"""WITH r AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL)
{_stop_sql("auc", ">", "max")} UNION ALL {_stop_sql("loss", "<", "min")}""")
def x29_early_stop(spark, sf):
    """A curve a user, in both directions."""
    e = table(spark, sf, "events")
    run = lambda name, up: X.early_stop(e, "user_id", "event_id", "value", 5, up).withColumn("metric", F.lit(name))
    return run("auc", True).union(run("loss", False)).select("user_id", "metric", "stop_round", "best_round")


@query()
def x30_superposition(spark, sf):
    import numpy as np

    @F.pandas_udf("double")
    def rmsd(a: pd.Series, b: pd.Series) -> pd.Series:
        shape = lambda x: np.asarray(x, float)[:63].reshape(21, 3)
        return pd.Series([X.kabsch_rmsd(shape(x), shape(y)) for x, y in zip(a, b)])

    e = table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", rmsd("embedding", "other").alias("rmsd"))
