"""Ways from a window tensor to a model's features, fitted on training rows only.

``fit`` sees the rows of ``train``; what it returns turns any rows into one array a row, in the
order of ``names``. Statistics and components are sums over rows; the driver holds tables of
one entry a dimension, and for components a matrix of features by features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.modelling import screen_dimensions
from strandline.operators.tensors import fit_components, flatten, pool, variance_by_dimension, zero_norm

MODES = ("flat", "flat_raw", "vardims", "simple21", "dimselect", "varfold", "autoencoder", "pool")


@dataclass
class Reduction:
    """Names of the features, the dimensions chosen (if any) and the way to make them."""

    mode: str
    names: list[str]
    apply: Callable[[DataFrame, str], DataFrame]
    dims: list[int] | None = None
    jaccard: float | None = None

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        return self.apply(df, out)


def _numbered_names(key: str, n: int) -> list[str]:
    return [f"{key}_PC{i + 1:03d}" for i in range(n)]


def _gather(mode: str, key: str, width: int, dims: list[int], names: list[str] | None = None, jaccard: float | None = None) -> Reduction:
    """The given dimensions of every slot, slot by slot."""
    return Reduction(mode, names or _numbered_names(key, width * len(dims)), lambda df, out: df.withColumn(out, flatten("window", dims)), dims, jaccard)


def _variance_order(df: DataFrame, dim_count: int) -> list[int]:
    """Dimensions by falling mean variance, ties by number; those without a value come last."""
    found = {r["dim"]: r["variance"] for r in variance_by_dimension(df).collect()}  # a row a dimension
    return sorted(range(dim_count), key=lambda d: (-found.get(d, 0.0), d))


def whole_rows() -> Column:
    """Rows without padding and without a slot of zeros: the same under every kind of filling."""
    return ~F.exists("pad_mask", lambda m: m) & ~F.exists("window", lambda v: zero_norm(v))


def fit(df: DataFrame, train: Column | str, mode: str, key: str, *, components: int = 500, dims: list[int] | None = None, top_n: int | None = None, latent: int = 64, method: str = "mean", masked: bool = True, label: str = "label", fold: str = "fold") -> Reduction:
    """``df`` holds row_id, ``window``, ``pad_mask``, and label and fold for ``dimselect``.

    - ``flat``: components of the whole flattened window, fitted on training rows without padding.
    - ``flat_raw``: all values. ``vardims``, ``simple21``: the given dimensions of each slot.
    - ``dimselect``: the ``top_n`` dimensions that tell training labels apart best, either way round.
    - ``varfold``: the ``top_n`` of the greatest variance in training rows; ``jaccard`` compares them with
      those of all rows and changes nothing.
    - ``autoencoder``: each slot in ``latent`` numbers by the linear map of least masked squared error, which
      is that of the leading components of the real training slots. Not the network with a rectifier.
    - ``pool``: one value (or two) a dimension.

    Rows with a null window get null features. Training rows that leave nothing to fit raise an error."""
    if mode not in MODES:
        raise ValueError(f"unknown reduction {mode!r}")
    rows = df.where(train)
    shape = rows.where("window is not null").select(F.size("window"), F.size(F.element_at("window", 1))).first()
    if shape is None:
        raise ValueError("no training rows")
    width, depth = shape
    if mode == "flat_raw":
        return Reduction(mode, _numbered_names(key, width * depth), lambda d, out: d.withColumn(out, flatten("window")))
    if mode in ("vardims", "simple21"):
        if not dims:
            raise ValueError(f"{mode} needs dims")
        return _gather(mode, key, width, list(dims))
    if mode == "pool":
        names = [f"{key}_pool-{part}_d{d + 1:04d}" for part in method.split("_") for d in range(depth)]
        return Reduction(mode, names, lambda d, out: pool(d, method, masked, out=out))
    if mode in ("dimselect", "varfold") and not top_n:
        raise ValueError(f"{mode} needs top_n")
    if mode == "dimselect":
        ranked = screen_dimensions(rows, label=label, fold=fold).where(~F.isnan("auc_disc")).orderBy(F.desc("auc_disc"), "dim").limit(top_n)
        chosen = sorted(r["dim"] for r in ranked.collect())  # a row a dimension
        if not chosen:
            raise ValueError("training rows of one class")
        return _gather(mode, key, width, chosen)
    if mode == "varfold":
        chosen, overall = (sorted(_variance_order(x, depth)[:top_n]) for x in (rows, df))
        both = len({*chosen} & {*overall}) / len({*chosen} | {*overall})
        return _gather(mode, key, width, chosen, [f"{key}_pos{p:02d}_dim{d:03d}" for p in range(width) for d in chosen], both)
    if mode == "flat":
        k = min(components, width * depth)
        model = fit_components(rows.where(whole_rows()).select(flatten("window").alias("_x")), "_x", k)
        return Reduction(mode, _numbered_names(key, k), lambda d, out: model(d.withColumn("_x", flatten("window")), out).drop("_x"))
    latent = min(latent, depth)
    real = F.filter(F.arrays_zip(F.col("window").alias("w"), F.col("pad_mask").alias("m")), lambda s: ~s.getField("m"))
    model = fit_components(rows.select(F.explode(F.transform(real, lambda s: s.getField("w"))).alias("_x")), "_x", latent)

    def encode(d: DataFrame, out: str) -> DataFrame:
        product = lambda v, w: F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        weights = [F.array(*map(F.lit, c)) for c in model.axes]
        shift = F.array(*map(F.lit, model.mean))
        each = lambda v: F.array(*[product(F.zip_with(v.cast("array<double>"), shift, lambda a, b: a - b), w) for w in weights])
        return d.withColumn(out, F.flatten(F.transform("window", each)))

    return Reduction(mode, [f"{key}_pos{p:02d}_z{i:03d}" for p in range(width) for i in range(latent)], encode)
