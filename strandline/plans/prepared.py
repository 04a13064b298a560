"""Prepared tensors: written in row order, read by number, checked against their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import reduction
from strandline.plans.registry import query
from strandline.plans.tables import tensor
from strandline.sources import prepared
from strandline.storage import new_path

FLANK, WIDTH = 3, 2
# rows are ordered by label and id; every seventh has no tensor, every eleventh a wrong label in it
_PREP = """t AS (SELECT vec_id, label, embedding, CASE WHEN vec_id % 11 = 0 THEN label + 1 ELSE label END AS said, least(vec_id % 5, 3)::INT AS n_pad, greatest(vec_id % 5 - 5, 0)::INT AS c_pad FROM embeddings WHERE vec_id % 7 <> 0),
p AS (SELECT *, row_number() OVER (ORDER BY label, vec_id) - 1 AS row_id FROM t)"""


def _prepared(spark, sf):
    """Labelled rows, and the path of their tensors."""
    path = new_path(spark, "prepared")
    t = tensor(spark, sf).withColumnRenamed("row_id", "vec_id")
    rows = t.select("vec_id", "label")
    said = F.when(F.col("vec_id") % 11 == 0, F.col("label") + 1).otherwise(F.col("label")).alias("said")
    prepared.write_prepared(rows, t.where("vec_id % 7 <> 0").select("vec_id", said, "window", "pad_mask"), ["vec_id"], ["label", "vec_id"], path, FLANK, WIDTH)
    return rows, path


@query(f"WITH {_PREP}, q AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 32 AS block FROM p WHERE row_id % 3 = 1) SELECT row_id, vec_id, label, n_pad, c_pad, block::BIGINT AS block, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM q")
def s12_k04_prepared_rows(spark, sf):
    """Every third row by its number, in blocks of 32."""
    _, path = _prepared(spark, sf)
    numbers = prepared.read_prepared(spark, path).select("row_id").where("row_id % 3 = 1")
    got = prepared.read_prepared(spark, path, numbers, block=32)
    total = F.aggregate(F.flatten("window"), F.lit(0.0), lambda a, x: a + x)
    return got.select("row_id", "vec_id", "label", "n_pad", "c_pad", "block", F.round(total, 6).alias("total"))


@query("SELECT count_if(vec_id % 7 <> 0)::BIGINT AS met, count_if(vec_id % 7 = 0)::BIGINT AS rows_only, 0::BIGINT AS tensor_only, count_if(vec_id % 7 <> 0 AND vec_id % 11 = 0)::BIGINT AS label_differs FROM embeddings")
def t10_alignment(spark, sf):
    rows, path = _prepared(spark, sf)
    held = prepared.read_prepared(spark, path).select("vec_id", F.col("said").alias("label"))
    return prepared.alignment(rows, held, ["vec_id"], ["label"])


@query(f"""WITH {_PREP} SELECT (vec_id % 5)::INT AS status, count(*) AS n, avg(n_pad) AS n_pad_mean, max(n_pad) AS n_pad_max, avg(c_pad) AS c_pad_mean, max(c_pad) AS c_pad_max, count_if(n_pad = 3)::BIGINT AS n_full,
CASE vec_id % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'fallback' WHEN 2 THEN 'missing' WHEN 3 THEN 'notfound' END AS meaning FROM p GROUP BY vec_id % 5""")
def t10_window_coverage(spark, sf):
    _, path = _prepared(spark, sf)
    return prepared.window_coverage(prepared.read_prepared(spark, path), FLANK, F.col("vec_id") % 5)


@query("""WITH r AS (SELECT unnest([{'region': 'head', 'zero': vec_id % 4 = 0}, {'region': 'tail', 'zero': false}]) AS s FROM embeddings)
SELECT s.region AS region, count_if(s.zero)::BIGINT AS zeros, 100.0::DOUBLE * count_if(s.zero) / count(*) AS percent FROM r GROUP BY 1""")
def t10_zero_vectors(spark, sf):
    t = tensor(spark, sf)
    head = F.when(F.col("row_id") % 4 == 0, F.transform(F.element_at("window", 1), lambda x: x * 0)).otherwise(F.element_at("window", 1))
    return prepared.zero_vectors(t.select(head.alias("head"), F.element_at("window", 8).alias("tail")), ["head", "tail"])


_CUT = """x AS (SELECT vec_id AS row_id, i // 8 AS slot, i % 8 AS dim, (i // 8) < vec_id % 5 AS pad, embedding[i + 1]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)),
v AS (SELECT row_id, dim, var_pop(value) AS v FROM x WHERE NOT pad AND row_id % 3 <> 0 GROUP BY 1, 2 HAVING count(*) > 1),
top AS (SELECT dim FROM v GROUP BY 1 ORDER BY avg(v) DESC, dim LIMIT 3)"""


@query(f"WITH {_CUT} SELECT row_id, 'emb_pos' || lpad(slot::VARCHAR, 2, '0') || '_dim' || lpad(dim::VARCHAR, 3, '0') AS feature, round(value, 6) AS value FROM x WHERE dim IN (SELECT dim FROM top)")
def m09_fold_variance(spark, sf):
    """The three dimensions of the greatest variance in the training rows, of every slot, by name."""
    r = reduction.fit(tensor(spark, sf), F.col("row_id") % 3 != 0, "varfold", "emb", top_n=3)
    names = F.array(*map(F.lit, r.names))
    each = F.explode(F.arrays_zip(names.alias("f"), F.col("features").alias("v"))).alias("z")
    return r.transform(tensor(spark, sf)).select("row_id", each).select("row_id", F.col("z.f").alias("feature"), F.round("z.v", 6).alias("value"))


@query()
def m09_reductions(spark, sf):
    """Every reduction fitted on the same training rows: number of features and the sum of squares of
    the other rows' features."""
    t = tensor(spark, sf).withColumns({"label": (F.col("label") < 5).cast("int"), "fold": (F.col("row_id") % 6).cast("int")})
    train = F.col("row_id") % 3 != 0
    settings = {"flat": {"components": 10}, "flat_raw": {}, "vardims": {"dims": [1, 4, 6]}, "dimselect": {"top_n": 3}, "varfold": {"top_n": 3}, "autoencoder": {"latent": 4}, "pool": {"method": "mean_std"}}
    out = None
    for mode, options in settings.items():
        r = reduction.fit(t, train, mode, "emb", **options)
        squares = F.aggregate(F.transform("features", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
        one = r.transform(t.where(~train)).agg(F.max(F.size("features")).alias("features"), F.round(F.sum(squares), 4).alias("squares"))
        one = one.select(F.lit(mode).alias("mode"), F.lit(len(r.names)).alias("names"), "features", "squares")
        out = one if out is None else out.unionByName(one)
    return out
