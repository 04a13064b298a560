"""Window tensors: a row holds ``window``, an array of slots, each an array of dimensions, and
``pad_mask``, true for slots outside the sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POOLS = ("mean", "median", "max", "min", "mean_max", "mean_median", "mean_std")
FILLS = ("zero", "impute_boundary", "impute_bos_eos", "pad_token")


def flatten(window: Column | str, dims: list[int] | None = None) -> Column:
    """All slots in one array, or the given dimensions (0-based) of each."""
    window = F.col(window) if isinstance(window, str) else window
    if dims is None:
        return F.flatten(window)
    return F.flatten(F.transform(window, lambda v: F.array(*[F.element_at(v, d + 1) for d in dims])))


def real_slots(window: Column | str, mask: Column | str) -> Column:
    """Slots that aren't padding; all of them in a fully padded row."""
    window, mask = (F.col(x) if isinstance(x, str) else x for x in (window, mask))
    pairs = F.arrays_zip(window.alias("w"), mask.alias("m"))
    kept = F.transform(F.filter(pairs, lambda s: ~s.getField("m")), lambda s: s.getField("w"))
    return F.when(F.size(kept) > 0, kept).otherwise(window)


def pool(df: DataFrame, method: str, masked: bool = True, window: str = "window", mask: str = "pad_mask", out: str = "pooled") -> DataFrame:
    """One value a dimension over the real slots (or all), in numpy on Arrow batches.
    ``mean_std`` uses the population deviation; two-part methods give both parts in a row."""
    if method not in POOLS:
        raise ValueError(f"unknown pooling {method!r}")

    @F.pandas_udf("array<double>")
    def run(w: pd.Series, m: pd.Series) -> pd.Series:
        def one(x, p):
            if x is None or not len(x):
                return None
            x = np.stack(x).astype(np.float64)
            p = np.asarray(p, bool)
            if masked and not p.all():
                x = x[~p]
            parts = {"mean": x.mean(0), "median": np.median(x, 0), "max": x.max(0), "min": x.min(0), "std": x.std(0)}
            return np.concatenate([parts[k] for k in method.split("_")])

        return pd.Series([one(x, p) for x, p in zip(w, m)])

    return df.withColumn(out, run(window, mask))


def long_form(df: DataFrame, row: str = "row_id", window: str = "window", mask: str = "pad_mask") -> DataFrame:
    """row, slot, dim, value, pad."""
    slots = df.select(row, F.posexplode(F.arrays_zip(F.col(window).alias("w"), F.col(mask).alias("m"))).alias("slot", "s"))
    return slots.select(row, "slot", F.col("s.m").alias("pad"), F.posexplode("s.w").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


def variance_by_dimension(df: DataFrame, row: str = "row_id", **names) -> DataFrame:
    """Mean over samples of the population variance over real slots; samples with at most
    one real slot are left out."""
    each = long_form(df, row, **names).where("not pad").groupBy(row, "dim").agg(F.var_pop("value").alias("v"), F.count("*").alias("n")).where("n > 1")
    return each.groupBy("dim").agg(F.avg("v").alias("variance"), F.count("*").alias("samples"))


def leading_dimensions(ranked: DataFrame, share: float, value: str = "variance", dim: str = "dim") -> DataFrame:
    """The fewest dimensions whose cumulative share reaches ``share``."""
    w = Window.orderBy(F.desc(value), dim)  # a row a dimension
    whole = F.sum(value).over(Window.partitionBy())
    out = ranked.withColumns({"rank": F.row_number().over(w), "before": (F.sum(value).over(w) - F.col(value)) / whole})
    return out.where(F.col("before") < share).drop("before")


def pad_counts(mask: Column | str, flank: int, width: int = 9) -> Column:
    """Padded slots before and after the peptide."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    count = lambda m: F.size(F.filter(m, lambda x: x))
    return F.struct(count(F.slice(mask, 1, flank)).alias("n_pad"), count(F.slice(mask, flank + width + 1, flank)).alias("c_pad"))


def build_window(residues: Column | str, start: Column | str, flank: int, width: int, fill: str, pad: Column | None = None, bos: Column | None = None, eos: Column | None = None) -> Column:
    """The residues' values by slot, slots outside filled in one of four ways."""
    if fill not in FILLS:
        raise ValueError(f"unknown fill {fill!r}")
    r, s = (F.col(x) if isinstance(x, str) else x for x in (residues, start))
    n = F.size(r)

    def slot(j):
        i = s - flank + j
        inside = (i >= 1) & (i <= n)
        if fill == "zero":
            other = F.lit(0.0)
        elif fill == "impute_boundary":
            other = F.element_at(r, F.greatest(F.lit(1), F.least(i, n)))
        elif fill == "impute_bos_eos":
            other = F.when(i < 1, bos).otherwise(eos)
        else:
            other = pad
        return F.when(inside, F.try_element_at(r, F.when(inside, i).otherwise(1))).otherwise(other)

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), slot)


def imputed_mean(values: Column | str, size: int, side: str, fallback: Column | None = None) -> Column:
    """Mean of a region brought to ``size`` values: an edge value is repeated, an empty
    region takes the fallback, a longer one is cut. Null without either."""
    v = F.col(values) if isinstance(values, str) else values
    if fallback is not None:
        v = F.when(F.size(v) > 0, v).when(fallback.isNotNull(), F.array(fallback)).otherwise(v)
    edge = F.element_at(v, 1) if side == "left" else F.element_at(v, -1)
    lack = F.greatest(F.lit(0), F.lit(size) - F.size(v))
    total = F.aggregate(F.slice(v, 1, size), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(v) > 0, (total + edge * lack) / size)


def zero_norm(vector: Column | str) -> Column:
    """T08."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) == 0


class Components:
    """A fitted centring and rotation; called on rows it adds their components."""

    def __init__(self, column: str, centre, pca):
        self.column, self.centre, self.pca = column, centre, pca

    @property
    def mean(self) -> list[float]:
        return [float(x) for x in self.centre.mean]

    @property
    def axes(self) -> list[list[float]]:
        """One list of weights a component."""
        return self.pca.pc.toArray().T.tolist()

    def __call__(self, df: DataFrame, out: str = "pca") -> DataFrame:
        """Null vectors have null components."""
        from pyspark.ml.functions import array_to_vector, vector_to_array

        filled = F.coalesce(F.col(self.column).cast("array<double>"), F.array_repeat(F.lit(0.0), len(self.mean)))
        done = self.pca.transform(self.centre.transform(df.withColumn("_v", array_to_vector(filled))))
        return done.withColumn(out, F.when(F.col(self.column).isNotNull(), vector_to_array("_p"))).drop("_v", "_c", "_p")


def fit_components(rows: DataFrame, column: str, k: int) -> Components:
    """The leading ``k`` components of the rows with a vector; the driver holds the covariance."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    vectors = rows.where(F.col(column).isNotNull()).select(array_to_vector(F.col(column).cast("array<double>")).alias("_v"))
    if vectors.isEmpty():
        raise ValueError("no rows to fit components on")
    centre = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(vectors)
    return Components(column, centre, PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(vectors)))


def principal_components(df: DataFrame, column: str, k: int, fit_where: Column | None = None, out: str = "pca") -> DataFrame:
    """Components fitted on the selected rows, all rows transformed, centred."""
    return fit_components(df.where(fit_where) if fit_where is not None else df, column, k)(df, out)


def spectrum(df: DataFrame, column: str, dims: int) -> list[float]:
    """Exact eigenvalues of the covariance from partial Gram sums of the partitions
    (dims x dims numbers each), merged on the driver."""

    def grams(batches):
        total = np.zeros((dims + 1, dims + 1))
        for pdf in batches:
            x = np.stack(pdf[column]) if len(pdf) else np.zeros((0, dims))
            x = np.hstack([np.ones((len(x), 1)), x.astype(float)])
            total += x.T @ x
        yield pd.DataFrame({"i": range(dims + 1), "g": list(total)})

    parts = df.select(column).mapInPandas(grams, "i int, g array<double>")
    rows = parts.groupBy("i").agg(*[F.sum(F.element_at("g", j + 1)).alias(str(j)) for j in range(dims + 1)]).orderBy("i").collect()
    g = np.array([[r[str(j)] for j in range(dims + 1)] for r in rows])
    n = g[0, 0]
    mean = g[0, 1:] / n
    return sorted(np.linalg.eigvalsh((g[1:, 1:] - n * np.outer(mean, mean)) / (n - 1)).tolist(), reverse=True)
