"""Array and tensor queries. An embedding of 64 numbers is seen as 8 slots of 8 dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import structure, tensors
from strandline.plans.base import table
from strandline.plans.registry import query


def tensor(spark, sf):
    e = table(spark, sf, "embeddings")
    slots = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice(F.col("embedding"), i * 8 + 1, F.lit(8)), lambda x: x.cast("double")))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i < F.col("vec_id") % 5)
    return e.select(F.col("vec_id").alias("row_id"), "label", "embedding", slots.alias("window"), mask.alias("pad_mask"))


LONG = """long AS (SELECT row_id, label, i // 8 AS slot, i % 8 AS dim, (i // 8) < row_id % 5 AS pad, embedding[i + 1]::DOUBLE AS value FROM (SELECT vec_id AS row_id, label, embedding, unnest(range(0, 64)) AS i FROM embeddings))"""


@query("SELECT vec_id AS row_id, unnest(range(0, 16))::INT AS place, round(unnest(list_transform(range(0, 16), lambda i: embedding[(i // 2) * 8 + CASE WHEN i % 2 = 0 THEN 3 ELSE 6 END])::DOUBLE[]), 6) AS value FROM embeddings")
def t01_flatten_dimensions(spark, sf):
    t = tensor(spark, sf).select("row_id", F.posexplode(tensors.flatten("window", [2, 5])).alias("place", "value"))
    return t.select("row_id", "place", F.round("value", 6).alias("value"))


def _pooled(spark, sf, method):
    t = tensors.pool(tensor(spark, sf), method)
    return t.select("row_id", F.posexplode("pooled").alias("place", "value")).select("row_id", "place", F.round("value", 6).alias("value"))


_POOL = "WITH " + LONG + " SELECT row_id, dim::INT AS place, round({}(value), 6) AS value FROM long WHERE NOT pad GROUP BY 1, 2"


@query(_POOL.format("avg"))
def t02_pool_mean(spark, sf):
    return _pooled(spark, sf, "mean")


@query(_POOL.format("median"))
def t02_pool_median(spark, sf):
    return _pooled(spark, sf, "median")


@query(_POOL.format("max"))
def t02_pool_max(spark, sf):
    return _pooled(spark, sf, "max")


@query("WITH " + LONG + " SELECT row_id, dim::INT AS place, round(avg(value), 6) AS value FROM long WHERE NOT pad GROUP BY 1, 2 UNION ALL SELECT row_id, dim::INT + 8, round(stddev_pop(value), 6) FROM long WHERE NOT pad GROUP BY 1, 2")
def t02_pool_mean_std(spark, sf):
    return _pooled(spark, sf, "mean_std")


@query("WITH " + LONG + ", v AS (SELECT row_id, dim, var_pop(value) AS v FROM long WHERE NOT pad GROUP BY 1, 2 HAVING count(*) > 1) SELECT dim::INT AS dim, round(avg(v), 6) AS variance, count(*) AS samples FROM v GROUP BY 1")
def t03_variance_by_dimension(spark, sf):
    return tensors.variance_by_dimension(tensor(spark, sf)).select("dim", F.round("variance", 6).alias("variance"), "samples")


@query("WITH " + LONG + """, v AS (SELECT row_id, dim, var_pop(value) AS v FROM long WHERE NOT pad GROUP BY 1, 2 HAVING count(*) > 1), d AS (SELECT dim::INT AS dim, avg(v) AS variance FROM v GROUP BY 1),
c AS (SELECT *, row_number() OVER (ORDER BY variance DESC, dim)::INT AS rank, sum(variance) OVER (ORDER BY variance DESC, dim) - variance AS before, sum(variance) OVER () AS whole FROM d) SELECT dim, rank FROM c WHERE before / whole < 0.6""")
def t04_leading_dimensions(spark, sf):
    return tensors.leading_dimensions(tensors.variance_by_dimension(tensor(spark, sf)), 0.6).select("dim", "rank")


@query()
def t05_t06_principal_components(spark, sf):
    t = tensor(spark, sf).withColumn("flat", tensors.flatten("window"))
    out = tensors.principal_components(t, "flat", 3, fit_where=~F.exists("pad_mask", lambda m: m) & ~tensors.zero_norm("flat"))
    return out.select("row_id", *[F.round(F.abs(F.element_at("pca", i)), 4).alias(f"abs_pc{i}") for i in (1, 2, 3)])


@query()
def t07_spectrum(spark, sf):
    values = tensors.spectrum(table(spark, sf, "embeddings").select("embedding"), "embedding", 64)
    return spark.createDataFrame([(i + 1, round(v, 8)) for i, v in enumerate(values)], "component int, variance double")


@query("SELECT vec_id AS row_id, vec_id % 5 = 0 AS real, false AS zero FROM embeddings")
def t08_row_filters(spark, sf):
    t = tensor(spark, sf)
    return t.select("row_id", (~F.exists("pad_mask", lambda m: m)).alias("real"), tensors.zero_norm("embedding").alias("zero"))


@query("WITH " + LONG + ", c AS (SELECT row_id, sum(pad::INT) AS pads FROM long GROUP BY 1) SELECT CASE WHEN pads = 0 THEN 'full' WHEN pads < 64 THEN 'part' ELSE 'none' END AS status, count(*) AS n FROM c GROUP BY 1")
def t10_coverage(spark, sf):
    pads = F.size(F.filter("pad_mask", lambda m: m))
    status = F.when(pads == 0, "full").when(pads < 8, "part").otherwise("none")
    return tensor(spark, sf).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT vec_id AS old_id, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS new_id FROM embeddings WHERE label < 3")
def t11_k04_subset(spark, sf):
    """Rows of a mask, renumbered in order: positions from range-dealt counts, not one window."""
    from strandline.operators.order import numbered

    t = table(spark, sf, "embeddings").where("label < 3").select(F.col("vec_id").alias("old_id"))
    return numbered(t, ["old_id"], "new_id")


@query()
def t13_dimension_screening(spark, sf):
    from strandline.operators.modelling import screen_dimensions

    return screen_dimensions(tensor(spark, sf).withColumn("y", (F.col("label") < 5).cast("int")).withColumn("fold", (F.col("row_id") % 6).cast("int")))


@query()
def t16_structure_features(spark, sf):
    """Probabilities of the eight states made from an embedding's slots."""
    t = tensor(spark, sf)
    p = F.transform(F.col("window"), lambda s: F.transform(s, lambda x: (x + 1) / 2))
    t = t.select("row_id", p.alias("p")).select("row_id", F.slice("p", 1, 2).alias("n"), F.slice("p", 3, 4).alias("pep"), F.slice("p", 7, 2).alias("c"))
    return structure.with_features(t, "n", "pep", "c", 2).select("row_id", *structure.FEATURES)
