"""ROC curves as tables, and where two of them pass each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.statistics import delong, normal_p

STEPS = 1000


def roc_grid(df: DataFrame, score: str, label: str, by: list[str], steps: int = STEPS) -> DataFrame:
    """``by``, k, tpr: the curve's height at the false positive rates k / steps.

    Corners of the curve are running counts over the distinct scores. Each stretch between
    successive false positive counts holds the grid places from its first on, so a place falls in
    exactly one stretch and no range join is needed; places are found with whole numbers.
    """
    each = df.groupBy(*by, F.col(score).alias("v")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    down, whole = Window.partitionBy(*by).orderBy(F.desc("v")), Window.partitionBy(*by)
    seen = each.select(*by, F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(whole).alias("all_p"), F.sum("n").over(whole).alias("all_n"))
    corner = seen.groupBy(*by, "fp", "all_p", "all_n").agg(F.min("tp").alias("enters"), F.max("tp").alias("leaves"))
    origin = corner.select(*by, F.lit(0).cast("long").alias("fp"), "all_p", "all_n", F.lit(0).cast("long").alias("enters"), F.lit(0).cast("long").alias("leaves")).distinct()
    corner = corner.union(origin).groupBy(*by, "fp", "all_p", "all_n").agg(F.min("enters").alias("enters"), F.max("leaves").alias("leaves"))
    right = Window.partitionBy(*by).orderBy("fp")
    stretch = corner.withColumns({"next_fp": F.lead("fp").over(right), "next_tp": F.lead("enters").over(right)}).where("all_p > 0 and all_n > 0")
    first = f"(({steps} * fp + all_n - 1) div all_n)"
    last = f"coalesce(({steps} * next_fp + all_n - 1) div all_n - 1, {steps})"
    placed = stretch.withColumn("k", F.explode(F.expr(f"if({last} >= {first}, sequence({first}, {last}), array())")))
    rise = F.coalesce((F.col("next_tp") - F.col("leaves")) * (F.col("k") * F.col("all_n") / steps - F.col("fp")) / (F.col("next_fp") - F.col("fp")), F.lit(0.0))
    return placed.select(*by, F.col("k").cast("int").alias("k"), ((F.col("leaves") + rise) / F.col("all_p")).alias("tpr"))


def compare_rocs(df: DataFrame, a: str, b: str, label: str, by: list[str], amplitude: float = 0.002, margin: float = 0.01, wiggle: float = 0.05, p: float = 0.05, mass: float = 0.05, flip: float = 0.02, steps: int = STEPS) -> DataFrame:
    """How the curve of score ``a`` runs against that of ``b``, by group.

    Between ``margin`` and 1 - ``margin``, only places where the heights differ by ``amplitude`` count.
    crossings, crossing_at: changes of the leading curve between successive such places, and where the
    line between the two gaps is 0. max_gap, max_gap_at: the widest gap and its first place.
    disagree_range: the share of places led by the score of the smaller area, and max_flip its widest
    gap there. verdict: crossing, near_identical (no place counts) or clean. tier: clean without a
    crossing; noise, if all are below ``wiggle``; critical, if the areas differ (paired test at ``p``) and
    the loser leads over ``mass`` by ``flip``; else weak. Groups of one class give no row.
    """
    left, right = (roc_grid(df, s, label, by, steps).withColumnRenamed("tpr", f"tpr_{x}") for s, x in ((a, "a"), (b, "b")))
    test = delong(df, a, b, label, by=by).withColumn("p", normal_p(F.col("z"))).select(*by, "auc_a", "auc_b", "delta", "p")
    gap = left.join(right, [*by, "k"]).where((F.col("k") > round(margin * steps)) & (F.col("k") < round((1 - margin) * steps))).withColumn("gap", F.col("tpr_a") - F.col("tpr_b"))
    gap = gap.join(test, by).withColumn("counts", F.abs("gap") >= amplitude)
    # the place that counted last before each
    earlier = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    gap = gap.withColumn("before", F.last(F.when(F.col("counts"), F.struct("k", "gap")), ignorenulls=True).over(earlier))
    crossed = F.col("counts") & (F.signum("gap") != F.signum("before.gap"))
    at = F.round((F.col("before.k") + (F.col("k") - F.col("before.k")) * F.abs("before.gap") / (F.abs("before.gap") + F.abs("gap"))) / steps, 4)
    against = F.col("counts") & (F.col("delta") != 0) & (F.signum("gap") != F.signum("delta"))
    out = gap.groupBy(*by, "auc_a", "auc_b", "delta", "p").agg(
        F.sort_array(F.collect_list(F.when(crossed, at))).alias("crossing_at"),
        F.max(F.abs("gap")).alias("max_gap"),
        (F.max_by("k", F.struct(F.abs("gap"), -F.col("k"))) / steps).alias("max_gap_at"),
        F.round(F.count_if(against) / steps, 4).alias("disagree_range"),
        F.coalesce(F.max(F.when(against, F.abs("gap"))), F.lit(0.0)).alias("max_flip"),
    )
    count = F.size("crossing_at")
    verdict = F.when(count > 0, "crossing").when(F.col("max_gap") < amplitude, "near_identical").otherwise("clean")
    return out.withColumns({"crossings": count, "verdict": verdict, "tier": _tier(count, wiggle, p, mass, flip)})


def _tier(count: Column, wiggle: float, p: float, mass: float, flip: float) -> Column:
    serious = (F.col("p") < p) & (F.col("disagree_range") >= mass) & (F.col("max_flip") >= flip)
    return F.when(count == 0, "clean").when(F.forall("crossing_at", lambda x: x < wiggle), "noise").when(F.coalesce(serious, F.lit(False)), "critical").otherwise("weak")
