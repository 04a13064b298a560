"""Rank statistics, effect sizes, tests, corrections and metrics as DataFrame aggregates.

Ranks over all rows are worked out on the distinct values: a count for each value, then
running sums over the values. Without groups these sums are worked out by one task over the
distinct scores (not the rows): scores rounded to a fixed number of places bound it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import bootstrap


def value_counts(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives at each distinct score with the counts below it, by group."""
    by = by or []
    each = df.groupBy(*by, F.col(score).alias("v")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumns({"p_below": F.coalesce(F.sum("p").over(below), F.lit(0)), "n_below": F.coalesce(F.sum("n").over(below), F.lit(0))})


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties one half; null if a class is missing."""
    by = by or []
    t = value_counts(df.where(F.col(score).isNotNull()), score, label, by)
    wins = F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2))
    return t.groupBy(*by).agg(F.try_divide(wins, (F.sum("p") * F.sum("n")).cast("double")).alias("auc"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))


def two_sample(df: DataFrame, value: str, group: str, by: list[str] | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance, Mann-Whitney U and its tie-corrected z,
    Cliff's delta, common-language effect size, of group 1 against group 0."""
    by = by or []
    t = value_counts(df, value, group, by)
    n1, n0 = (F.sum(x).over(Window.partitionBy(*by)) for x in "pn")
    t = t.withColumns({"n1": n1, "n0": n0})
    ratio = F.try_divide  # a group without one of the samples gives nulls
    gap = F.abs(ratio(F.col("p_below") + F.col("p"), F.col("n1").cast("double")) - ratio(F.col("n_below") + F.col("n"), F.col("n0").cast("double")))
    ties = (F.col("p") + F.col("n")).cast("double")
    out = t.groupBy(*by).agg(
        F.max(gap).alias("ks"),
        F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2)).alias("u"),
        F.sum(ties * ties * ties - ties).alias("t3"),
        F.first("n1").cast("double").alias("n1"),
        F.first("n0").cast("double").alias("n0"),
    )
    n = F.col("n1") + F.col("n0")
    spread = F.sqrt(F.col("n1") * F.col("n0") / 12 * (n + 1 - ratio(F.col("t3"), n * (n - 1))))
    delta = ratio(2 * F.col("u"), F.col("n1") * F.col("n0")) - 1
    size = F.abs(F.col("delta"))
    return (
        out.withColumn("z", F.try_divide(F.col("u") - F.col("n1") * F.col("n0") / 2, spread))
        .withColumn("delta", delta)
        .withColumn("cles", (1 + F.col("delta")) / 2)
        .withColumn("magnitude", F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large"))
        .drop("t3")
    )


def delong_components(df: DataFrame, scores: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """For each row and score its placement among the other class, by group."""
    out, by = df, by or []
    classes = df.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("_n1"), F.count_if(F.col(label) == 0).alias("_n0"))
    for s in scores:
        t = value_counts(df, s, label, by)
        t = t.join(classes, by) if by else t.withColumns({c: F.lit(n) for c, n in classes.first().asDict().items()})
        ahead = F.try_divide(F.col("n_below") + F.col("n") / 2, F.col("_n0").cast("double"))
        behind = F.try_divide(F.col("_n1") - F.col("p_below") - F.col("p") / 2, F.col("_n1").cast("double"))
        t = t.select(*by, F.col("v").alias(s), ahead.alias("_ahead"), behind.alias("_behind"))
        out = out.join(t, [*by, s]).withColumn(f"v_{s}", F.when(F.col(label) == 1, F.col("_ahead")).otherwise(F.col("_behind"))).drop("_ahead", "_behind")
    return out


def delong(df: DataFrame, a: str, b: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Paired comparison of two areas by group: both, their difference, its variance and z."""
    by = by or []
    v = delong_components(df.select(*by, a, b, label), [a, b], label, by)
    g = v.groupBy(*by, F.col(label).alias("y")).agg(
        F.avg(f"v_{a}").alias("auc_a"), F.avg(f"v_{b}").alias("auc_b"), F.var_samp(f"v_{a}").alias("va"), F.var_samp(f"v_{b}").alias("vb"), F.covar_samp(f"v_{a}", f"v_{b}").alias("cv"), F.count("*").alias("n")
    )
    out = g.groupBy(*by).agg(
        F.max(F.when(F.col("y") == 1, F.col("auc_a"))).alias("auc_a"),
        F.max(F.when(F.col("y") == 1, F.col("auc_b"))).alias("auc_b"),
        F.sum((F.col("va") + F.col("vb") - 2 * F.col("cv")) / F.col("n")).alias("variance"),
    )
    return out.withColumn("delta", F.col("auc_a") - F.col("auc_b")).withColumn("z", F.try_divide("delta", F.sqrt("variance")))


def erfc(x: Column) -> Column:
    """Complementary error function by a published rational approximation (error below 1.2e-7)."""
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    # fixed values of the approximation
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(0.0)
    for k in reversed(terms):
        poly = F.lit(k) + t * poly
    r = t * F.exp(-z * z + poly)
    return F.when(x >= 0, r).otherwise(2 - r)


def normal_p(z: Column) -> Column:
    """Two-sided p-value."""
    return erfc(F.abs(z) / math.sqrt(2))


def adjust(df: DataFrame, p: str, method: str, by: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """P-values adjusted by Benjamini-Hochberg ("bh") or Holm; nulls stay null."""
    by = by or []
    rest = df.where(F.col(p).isNull()).withColumn("p_adj", F.lit(None).cast("double"))
    own = df.where(F.col(p).isNotNull())
    order = [p, tie] if tie else [p]
    w = Window.partitionBy(*by).orderBy(*order)
    own = own.withColumns({"_r": F.row_number().over(w), "_m": F.count("*").over(Window.partitionBy(*by))})
    if method == "bh":
        raw = F.col(p) * F.col("_m") / F.col("_r")
        out = F.min(raw).over(Window.partitionBy(*by).orderBy("_r").rowsBetween(0, Window.unboundedFollowing))
    else:
        raw = F.col(p) * (F.col("_m") - F.col("_r") + 1)
        out = F.max(raw).over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("p_adj", F.least(F.lit(1.0), out)).drop("_r", "_m").unionByName(rest)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of the crosstab of two columns, its degrees of freedom and Cramer's V."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("o"))
    ra, rb = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("rb"))
    total = cells.agg(F.sum("o").alias("n"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    # sum over all cells, empty ones included: n * (sum o^2 / (ra * rb) - 1)
    s = cells.join(ra, "a").join(rb, "b").agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("q"))
    one = s.withColumn("k", F.lit(1)).join(total.withColumn("k", F.lit(1)), "k").drop("k")
    return one.select(
        (F.col("n") * (F.col("q") - 1)).alias("chi2"),
        ((F.col("ka") - 1) * (F.col("kb") - 1)).cast("long").alias("df"),
        F.sqrt(F.try_divide(F.col("q") - 1, F.least("ka", "kb") - 1)).alias("cramers_v"),
        F.col("n").cast("long").alias("n"),
    )


def pearson(a: str, b: str) -> Column:
    """Correlation as an aggregate, null where a side doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def confusion_metrics(df: DataFrame, score: str, label: str, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """X19 at a threshold: accuracy, f1, mcc, sensitivity, specificity, ppv, npv."""
    by = by or []
    hit = F.col(score) >= threshold
    y = F.col(label) == 1
    t = df.groupBy(*by).agg(*[F.count_if(c).cast("double").alias(n) for n, c in (("tp", hit & y), ("fp", hit & ~y), ("fn", ~hit & y), ("tn", ~hit & ~y))])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    ratio = F.try_divide
    return t.select(
        *by,
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.coalesce(ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0)).alias("mcc"),
        ratio(tp, tp + fn).alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(tp, tp + fp).alias("ppv"),
        ratio(tn, tn + fn).alias("npv"),
    )


def average_precision(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the precision-recall steps over the distinct scores."""
    by = by or []
    each = df.groupBy(*by, F.col(score).alias("v")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(F.desc("v"))
    each = each.withColumns({"tp": F.sum("p").over(w), "seen": F.sum("c").over(w)})
    return each.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("seen")), F.sum("p")).alias("average_precision"))


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score and share of positives by equal-width bin."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("share"))


def standardized_difference(df: DataFrame, value: str, group: str) -> DataFrame:
    """Standardised mean difference with pooled deviation, its error and 95 % limits."""
    one = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    t = df.agg(one(F.avg, 1).alias("m1"), one(F.avg, 0).alias("m0"), one(F.var_samp, 1).alias("v1"), one(F.var_samp, 0).alias("v0"), one(F.count, 1).cast("double").alias("n1"), one(F.count, 0).cast("double").alias("n0"))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), F.col("n1") + F.col("n0") - 2))
    t = t.withColumn("smd", F.try_divide(F.col("m1") - F.col("m0"), pooled))
    t = t.withColumn("se", F.sqrt(F.try_divide(F.col("n1") + F.col("n0"), F.col("n1") * F.col("n0")) + F.try_divide(F.col("smd") * F.col("smd"), 2 * (F.col("n1") + F.col("n0")))))
    return t.select("smd", "se", (F.col("smd") - 1.96 * F.col("se")).alias("low"), (F.col("smd") + 1.96 * F.col("se")).alias("high"))


def poisson_draw(seed: Column, most: int = 12) -> Column:
    """A Poisson(1) count from a uniform number in [0, 1)."""
    cut, p, out = 0.0, math.exp(-1), None
    for k in range(most):
        cut += p
        out = F.when(seed < cut, k) if out is None else out.when(seed < cut, k)
        p /= k + 1
    return out.otherwise(most)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the parts: the same on any cluster, and in SQL."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)


def bootstrap_ks(df: DataFrame, value: str, group: str, row: str = "row_id", replicates: int = 50) -> DataFrame:
    """Percentile interval of the KS distance by a Poisson bootstrap, each row weighted
    anew in each replicate."""
    ks = bootstrap.distances(df, value, group, row, range(replicates))
    return ks.agg(F.percentile("ks", F.lit(0.025)).alias("low"), F.percentile("ks", F.lit(0.975)).alias("high"), F.avg("ks").alias("mean"))


def permuted_shares(clusters: DataFrame, cluster: str, rows: str, fold: str, replicates: int = 100) -> DataFrame:
    """Share of rows by fold against clusters dealt anew by the folds' shares."""
    totals = clusters.groupBy(fold).agg(F.sum(rows).alias("r")).orderBy(fold).collect()
    whole, cut, edges = sum(t["r"] for t in totals), 0.0, []
    for t in totals:
        cut += t["r"] / whole
        edges.append((cut, t[fold]))
    reps = clusters.select(cluster, rows, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    u = uniform("rep", cluster)
    pick = F.lit(edges[-1][1])
    for edge, f in reversed(edges[:-1]):
        pick = F.when(u < edge, F.lit(f)).otherwise(pick)
    null = reps.withColumn(fold, pick).groupBy("rep", fold).agg(F.sum(rows).alias("r")).groupBy(fold).agg(F.percentile("r", F.lit(0.025)).alias("null_lo"), F.percentile("r", F.lit(0.975)).alias("null_hi"))
    seen = clusters.groupBy(fold).agg(F.sum(rows).alias("observed"))
    flag = F.when((F.col("observed") < F.col("null_lo")) | (F.col("observed") > F.col("null_hi")), "OUTLIER").otherwise("ok")
    return seen.join(null, fold).withColumn("flag", flag)


# ------------------------------------------------------------------ small exact distributions


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def corrected_t(a: list[float], b: list[float]) -> tuple[float, float]:
    """Paired t over folds with the variance widened by 1/n + test/train."""
    d = np.array(a) - np.array(b)
    n = len(d)
    spread = d.std(ddof=1) * math.sqrt(1 / n + 1 / (n - 1))
    t = float(d.mean() / spread) if spread else float("nan")
    return t, t_p_value(t, n - 1)


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table, the sum of all tables at most as likely."""
    r1, c1, n = a + b, a + c, a + b + c + d
    log = lambda k: math.lgamma(k + 1)
    base = log(r1) + log(n - r1) + log(c1) + log(n - c1) - log(n)
    p = lambda x: math.exp(base - log(x) - log(r1 - x) - log(c1 - x) - log(n - r1 - c1 + x))
    own = p(a)
    return min(1.0, sum(q for x in range(max(0, r1 + c1 - n), min(r1, c1) + 1) if (q := p(x)) <= own * (1 + 1e-7)))


def kabsch_rmsd(a: np.ndarray, b: np.ndarray) -> float:
    """Root mean square distance after the best superposition."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    u, s, vt = np.linalg.svd(a.T @ b)
    s[-1] *= np.sign(np.linalg.det(u @ vt))
    return float(math.sqrt(max(0.0, ((a * a).sum() + (b * b).sum() - 2 * s.sum()) / len(a))))


def early_stop(curves: DataFrame, curve: str, step: str, value: str, patience: int = 50, maximise: bool = True) -> DataFrame:
    """For each curve the best round (from 1) so far when ``patience`` rounds have passed
    without a better one, and the round of the stop (the last one if that never happens).
    Null values are left out."""
    w = Window.partitionBy(curve)
    by_round = w.orderBy("round")
    best = F.max if maximise else F.min
    rounds = curves.where(F.col(value).isNotNull()).select(curve, F.col(value).alias("v"), F.row_number().over(w.orderBy(step)).alias("round"))
    before = best("v").over(by_round.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | ((F.col("v") > before) if maximise else (F.col("v") < before))
    marked = rounds.withColumn("new", F.when(better, F.col("round"))).withColumn("best_round", F.max("new").over(by_round))
    ends = (F.col("round") - F.col("best_round") >= patience)
    out = marked.groupBy(curve).agg(F.min(F.when(ends, F.col("round"))).alias("at"), F.max("round").alias("last"), F.max("best_round").alias("late"))
    return out.select(curve, F.coalesce("at", "last").alias("stop_round"), F.coalesce(F.col("at") - patience, "late").alias("best_round"))


def pr_curve(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Precision and recall when all rows of at least each distinct score count as positive."""
    by = by or []
    w = Window.partitionBy(*by)
    t = value_counts(df.where(F.col(score).isNotNull()), score, label, by)
    tp, fp = F.sum("p").over(w) - F.col("p_below"), F.sum("n").over(w) - F.col("n_below")
    return t.select(*by, F.col("v").alias("threshold"), F.try_divide(tp, (tp + fp).cast("double")).alias("precision"), F.try_divide(tp, F.sum("p").over(w).cast("double")).alias("recall"))


def profile_counts(df: DataFrame, text: str, by: str) -> DataFrame:
    """Number of rows with each symbol at each position, by group."""
    return df.select(by, F.posexplode(F.split(text, "")).alias("pos", "aa")).groupBy(by, "pos", "aa").agg(F.count("*").alias("n"))


def profile_divergence(counts: DataFrame, by: str, alphabet: str, pseudocount: float = 0.5) -> DataFrame:
    """Mean over the positions of the entropy, and of the divergence from all groups
    together (with pseudocounts, bits)."""
    cells = counts.select(by, "pos").distinct().withColumn("aa", F.explode(F.array(*[F.lit(a) for a in alphabet])))
    full = cells.join(counts, [by, "pos", "aa"], "left").na.fill(0, ["n"])
    both, whole = Window.partitionBy(by, "pos"), Window.partitionBy("pos", "aa")
    full = full.withColumns({"rows": F.sum("n").over(both), "all_n": F.sum("n").over(whole)}).withColumn("all_rows", F.sum("all_n").over(both))
    p, size = F.col("n") / F.col("rows"), pseudocount * len(alphabet)
    ps, qs = (F.col("n") + pseudocount) / (F.col("rows") + size), (F.col("all_n") + pseudocount) / (F.col("all_rows") + size)
    each = full.groupBy(by, "pos").agg((-F.sum(F.when(F.col("n") > 0, p * F.log2(p)).otherwise(0.0))).alias("entropy"), F.sum(ps * F.log2(ps / qs)).alias("kl"))
    return each.groupBy(by).agg(F.avg("entropy").alias("entropy"), F.avg("kl").alias("kl"))


def profile_correlation(counts: DataFrame, by: str, cells: int) -> DataFrame:
    """Pearson correlation of the frequency matrices of each two groups. Absent cells are
    zeros: they add to no sum, only to the number of ``cells``."""
    rows = F.sum("n").over(Window.partitionBy(by, "pos"))
    f = counts.select(by, "pos", "aa", (F.col("n") / rows).alias("f"))
    sums = f.groupBy(by).agg(F.sum("f").alias("s"), F.sum(F.col("f") * F.col("f")).alias("q"))
    a, b = f.withColumnsRenamed({by: "a", "f": "fa"}), f.withColumnsRenamed({by: "b", "f": "fb"})
    met = a.join(b, ["pos", "aa"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("fa") * F.col("fb")).alias("ab"))
    left, right = sums.toDF("a", "sa", "qa"), sums.toDF("b", "sb", "qb")
    spread = lambda s, q: F.col(q) * cells - F.col(s) * F.col(s)
    pcc = (F.col("ab") * cells - F.col("sa") * F.col("sb")) / F.sqrt(spread("sa", "qa") * spread("sb", "qb"))
    return met.join(left, "a").join(right, "b").select("a", "b", pcc.alias("pcc"))


def linkage_order(names: list, distance: np.ndarray) -> list:
    """The names in the order of an average-linkage tree, of a few groups' symmetric distances.
    The nearest two clusters merge (the earliest of equally near ones); the older one stands first."""
    d = np.asarray(distance, float)
    clusters = [[i] for i in range(len(names))]
    while len(clusters) > 1:
        gaps = [(d[np.ix_(clusters[i], clusters[j])].mean(), i, j) for j in range(len(clusters)) for i in range(j)]
        _, i, j = min(gaps)
        merged = clusters[i] + clusters[j]
        clusters = [x for k, x in enumerate(clusters) if k not in (i, j)] + [merged]
    return [names[i] for i in (clusters[0] if clusters else [])]
