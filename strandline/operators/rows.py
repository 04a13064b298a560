"""Row selection, deduplication, joins and ledgers on keyed tables.

Row order is the column ``row_id`` throughout: "first" means its least value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order.

    One row_number over the keys; Spark filters it before the exchange too, so hot
    keys send a row or so from each task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_values(df: DataFrame, keys: Sequence[str], order: str = "row_id") -> DataFrame:
    """The first non-null value of every column within each key."""
    rest = [x for x in df.columns if x not in keys and x != order]
    return df.groupBy(*keys).agg(*[F.min_by(x, F.when(F.col(x).isNotNull(), F.col(order))).alias(x) for x in rest])


def window_dedup(df: DataFrame, key: str = "context", label: str = "label", order: str = "row_id") -> DataFrame:
    """One row of each window: the first positive, else the first."""
    return first_by(df, [key], F.col(label).desc(), F.col(order))


def drop_orphans(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Positives, and negatives of groups that hold a positive. A semi-join, so no group is gathered."""
    good = df.where(F.col(label) == 1).select(group).distinct()
    return df.join(good, group, "left_semi")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys meet null keys; the right keys go."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that fails where a right key repeats or a left row finds nothing."""
    once = right.groupBy(*keys).agg(*[F.first(x).alias(x) for x in right.columns if x not in keys], F.count("*").alias("_n"))
    joined = left.join(once, list(keys), "left")
    fault = F.when(F.col("_n").isNull(), F.raise_error(F.lit("a row has no match"))).when(F.col("_n") > 1, F.raise_error(F.lit("a key repeats")))
    return joined.withColumn("_ok", F.coalesce(fault.cast("string"), F.lit("y"))).where("_ok = 'y'").drop("_ok", "_n")


def best_per_row(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str = "row_id", order: str = "r_id") -> DataFrame:
    """Inner join that keeps the first match of each left row."""
    return first_by(left.join(right, list(keys)), [row], order)


def occurrence(df: DataFrame, keys: Sequence[str], order: str = "row_id") -> DataFrame:
    """Number of each row among its key, so that repeated keys match one to one in order."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def ordered_match(full: DataFrame, part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``part`` with the row of ``full`` that they came from."""
    a = occurrence(full, keys).select(*keys, "occurrence", F.col("row_id").alias("full_row"))
    b = occurrence(part, keys).select(*keys, "occurrence", F.col("row_id").alias("part_row"))
    return b.join(a, [*keys, "occurrence"])


def intervals_by_array(spans: DataFrame, points: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Values at the places of each span [start, stop], in order.

    Points are gathered into one array a key (a sequence's length), the span takes a part
    of it: an equi-join, where a range predicate would compare each span with each point.
    """
    gathered = points.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v")))).alias("_all"))
    inside = F.filter("_all", lambda s: (s["p"] >= F.col("start")) & (s["p"] <= F.col("stop")))
    return spans.join(gathered, key, "left").withColumn("values", F.transform(inside, lambda s: s["v"])).drop("_all")


def ledger(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Independent flags, whether any holds, and the first that does as the reason."""
    out = df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()})
    any_of, reason = F.lit(False), None
    for k in rules:
        any_of = any_of | F.col(k)
        reason = F.when(F.col(k), k) if reason is None else reason.when(F.col(k), k)
    return out.withColumn("excluded", any_of).withColumn("reason", reason)


def cascade(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows left after each successive condition, in one pass."""
    held, sums = F.lit(True), []
    for name, condition in stages.items():
        held = held & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(held).alias(name))
    one = df.agg(*sums)
    pairs = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(n).alias("rows")) for i, n in enumerate(stages)])
    return one.select(F.explode(pairs).alias("s")).select("s.*")


def validate_positions(df: DataFrame, seq: str = "sequence", peptide: str = "peptide", start: str = "start", stop: str = "stop") -> DataFrame:
    """Whether the span holds the peptide; else its first occurrence, if any.

    A null or out-of-range span makes the check unknown, and the status stays null.
    """
    from strandline.functions.sequence import at, find_first

    found = find_first(seq, peptide)
    valid = at(seq, start, stop) == F.col(peptide)
    status = (
        F.when(F.col(seq).isNull(), "no_protein_sequence")
        .when(valid, "valid_original")
        .when(~valid & found.isNotNull(), "fixed")
        .when(~valid & found.isNull(), "unfixable")
    )
    out = df.withColumn("status", status)
    fixed = F.col("status") == "fixed"
    return out.withColumn("new_start", F.when(fixed, found).otherwise(F.col(start))).withColumn("new_stop", F.when(fixed, found + F.length(peptide) - 1).otherwise(F.col(stop))).withColumn("shift", F.when(fixed, found - F.col(start)))


def cut_windows(df: DataFrame, seq: str, width: int, step: int, flank: int) -> DataFrame:
    """Windows of ``width`` at every ``step``-th place (from 1) with the symbols up to ``flank`` before and after
    them: start, stop, peptide, raw_n, raw_c. They are cut from blocks of ``step`` symbols in one
    pass over the sequence, which needn't be carried along with its windows."""
    if width + flank > step:
        raise ValueError("a window and its right flank must fit a step")
    blocks = df.withColumn("_blocks", F.expr(f"regexp_extract_all({seq}, '.{{1,{step}}}', 0)"))
    cut = F.transform(
        "_blocks",
        lambda x, i: F.struct(
            (i * step + 1).alias("start"),
            (i * step + width).alias("stop"),
            F.substring(x, 1, width).alias("peptide"),
            F.when(i > 0, F.right(F.get("_blocks", i - 1), F.lit(flank))).otherwise("").alias("raw_n"),
            F.substring(x, width + 1, flank).alias("raw_c"),
        ),
    )
    each = blocks.withColumn("_w", F.explode(cut)).where(F.length("_w.peptide") == width)
    return each.select("*", "_w.*").drop("_w", "_blocks")


def kmers(df: DataFrame, seq: str, shortest: int = 8, longest: int = 14, block: int = 64) -> DataFrame:
    """All substrings of the lengths, a row each: start, n, kmer beside the other columns. They are
    cut from blocks with the symbols that follow, so a long sequence is passed over once."""
    blocks = df.withColumn("_blocks", F.expr(f"regexp_extract_all({seq}, '.{{1,{block}}}', 0)")).drop(seq)
    piece = F.transform("_blocks", lambda x, i: F.struct((i * block).alias("at"), F.length(x).alias("own"), F.concat(x, F.coalesce(F.substring(F.get("_blocks", i + 1), 1, longest - 1), F.lit(""))).alias("x")))
    pieces = blocks.withColumn("_p", F.explode(piece)).drop("_blocks")
    spot = pieces.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_p.own")))).withColumn("n", F.explode(F.sequence(F.lit(shortest), F.lit(longest))))
    out = spot.where(F.col("_i") + F.col("n") - 1 <= F.length("_p.x"))
    return out.withColumns({"start": F.col("_p.at") + F.col("_i"), "kmer": F.substring(F.col("_p.x"), F.col("_i"), F.col("n"))}).drop("_p", "_i")


def complete_flanks(df: DataFrame, size: int, length: str = "len", start: str = "start", stop: str = "stop") -> DataFrame:
    """Padded flanks, their real lengths, the window and relative distances, from raw_n, peptide, raw_c."""
    from strandline.functions import sequence as S

    whole = F.col(length).cast("double")
    left, right = S.pad_left(F.col("raw_n"), size), S.pad_right(F.col("raw_c"), size)
    return df.withColumns(
        {
            "n_real": F.length("raw_n"),
            "c_real": F.length("raw_c"),
            "n_flank": left,
            "c_flank": right,
            "context": F.concat(left, F.col("peptide"), right),
            "rel_n": (F.col(start) - 1) / whole,
            "rel_c": (whole - F.col(stop)) / whole,
        }
    )


def add_flanks(df: DataFrame, size: int = 5, seq: str = "sequence", start: str = "start", stop: str = "stop") -> DataFrame:
    """Raw and padded flanks, their real lengths, the window and relative distances."""
    from strandline.functions import sequence as S

    raw_n, raw_c = S.left_flank(seq, start, size), S.right_flank(seq, stop, size)
    length = F.length(seq).cast("double")
    return df.withColumns(
        {
            "n_real": F.length(raw_n),
            "c_real": F.length(raw_c),
            "n_flank": S.pad_left(raw_n, size),
            "c_flank": S.pad_right(raw_c, size),
            "context": S.context(seq, start, stop, size),
            "rel_n": (F.col(start) - 1) / length,
            "rel_c": (length - F.col(stop)) / length,
        }
    )


def shorten_windows(df: DataFrame, old: int = 10, new: int = 5) -> DataFrame:
    """The inner part of wider windows, with clipped real lengths and paddings."""
    cut = old - new
    return df.withColumns(
        {
            "n_flank": F.substring("n_flank", cut + 1, new),
            "c_flank": F.substring("c_flank", 1, new),
            "context": F.col("context").substr(F.lit(cut + 1), F.length("context") - 2 * cut),
            "n_real": F.least("n_real", F.lit(new)),
            "c_real": F.least("c_real", F.lit(new)),
        }
    ).withColumns({"n_pad": F.lit(new) - F.col("n_real"), "c_pad": F.lit(new) - F.col("c_real")})
