"""Line dedup by winnowing over line hashes, in DataFrame operations only.

1. Among each ``window`` successive non-blank lines of a document the least hash (the last
   among equals) is a fingerprint, so two documents that share a run of ``window`` lines share a
   fingerprint within it. Fingerprints found at one position only are dropped.
2. Positions are joined: a window that picked a fingerprint meets the earliest window of the same
   lines, which makes a match of two places. Later places meet that one only, so a group of
   copies gives as many matches as it has members, not as many as it has pairs.
3. Matches are extended both ways: those of one document that follow each other on the same
   diagonal of the same earlier document become one run of lines.
4. Runs that touch are merged, and their lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._common import NULL_ID, join_counted, materialize

SOLID = "x -> x rlike '[^\\\\s]'"
PLACE = ("doc", "th")


def _windows(source: DataFrame, window: int) -> DataFrame:
    """f, fresh, key, check, doc, th, j of every window: its fingerprint and whether it is the first
    window to pick that position, two hashes of its lines, and its place."""
    solid = source.select(*PLACE, F.expr(f"filter(lines, {SOLID})").alias("lines")).where(F.size("lines") >= window)
    hashed = solid.select(*PLACE, F.expr("transform(lines, x -> xxhash64(x))").alias("f"), F.expr("transform(lines, x -> xxhash64(1, x))").alias("g")).dropDuplicates(list(PLACE))
    # arrays are read by place: an expression on a whole array within a function would be worked out for each element
    least = f"array_min(slice(f, j + 1, {window}))"
    picks = f"transform(sequence(0, size(f) - {window}), j -> int(j + {window} - array_position(reverse(slice(f, j + 1, {window})), {least})))"
    each = hashed.withColumn("i", F.expr(picks)).select(
        *PLACE, F.explode(F.expr(f"transform(i, (i0, j) -> struct(f[i0] as f, j = 0 or i[j - 1] <> i0 as fresh, xxhash64(slice(f, j + 1, {window})) as key, xxhash64(slice(g, j + 1, {window})) as check, j))")).alias("w")
    )
    return each.select("w.*", *PLACE)


def _extended(matches: DataFrame, window: int) -> DataFrame:
    """doc, th and the runs (a, b: first and last line, counted without blank ones) of matched windows."""
    within = Window.partitionBy(*PLACE)
    along = within.orderBy("first.doc", "first.th", F.col("j") - F.col("first.j"), "j")
    before = F.lag(F.struct(F.col("first.doc"), F.col("first.th"), F.col("j") - F.col("first.j"), F.col("j"))).over(along)
    here = F.struct(F.col("first.doc"), F.col("first.th"), F.col("j") - F.col("first.j"), F.col("j") - 1)
    runs = matches.withColumn("new", F.when(before.eqNullSafe(here), 0).otherwise(1)).withColumn("run", F.sum("new").over(along))
    runs = runs.groupBy(*PLACE, "run").agg(F.min("j").alias("a"), (F.max("j") + window - 1).alias("b"))
    # runs of different sources that overlap or touch become one
    order = within.orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = runs.withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    merged = merged.groupBy(*PLACE, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def remove_repeated_lines(docs: DataFrame, window: int = 2, keep_text: bool = False) -> DataFrame:
    """doc_id, n_lines (non-blank), n_removed, n_runs and kept_sha256 of every row; with
    ``keep_text`` also the kept text.

    A run of ``window`` or more successive non-blank lines is deleted where it also starts
    earlier (in a document before, or the same document, an earlier line). Blank lines (white
    space only) are neither counted nor deleted. Rows with one doc_id and one text are one
    document and lose nothing to each other; different texts under one doc_id (or under none) are
    documents of their own, in the order of their MD5. A null id comes before all others; a null
    text is empty; a document of fewer than ``window`` lines loses nothing. Other columns are
    ignored. Lines are compared by 128 bits of hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.unhex(F.md5(text.cast("binary"))).alias("th"),
        F.split(text, "\n", -1).alias("lines"),
    )
    windows = materialize(_windows(source, window), "line-windows")
    often = materialize(windows.where("fresh").groupBy("f").agg(F.count("*").alias("c")).where("c > 1"), "line-fingerprints")
    matched = materialize(join_counted(windows, often, ["f"], windows.count()).select("key", "check", *PLACE, "j"), "line-positions")
    first = materialize(matched.groupBy("key", "check").agg(F.min(F.struct(*PLACE, "j")).alias("first"), F.count("*").alias("c")).where("c > 1"), "line-firsts")
    later = join_counted(matched, first, ["key", "check"], matched.count()).where("struct(doc, th, j) <> first")
    out = source.join(_extended(later, window), list(PLACE), "left").withColumn("runs", F.coalesce("runs", F.expr("array()").cast("array<struct<a:int,b:int>>")))
    # the lines between runs stay, and the blank ones within
    out = out.withColumn("places", F.expr(f"filter(transform(lines, (x, k) -> if({SOLID.removeprefix('x -> ')}, k, cast(null as int))), k -> k is not null)"))
    out = out.withColumn("cuts", F.expr("transform(runs, r -> struct(places[r.a] as a, places[r.b] + 1 as b))"))
    between = "transform(sequence(0, size(cuts)), k -> slice(lines, if(k = 0, 0, cuts[k - 1].b) + 1, if(k = size(cuts), size(lines), cuts[k].a) - if(k = 0, 0, cuts[k - 1].b)))"
    blank = f"transform(sequence(0, size(cuts)), k -> if(k = size(cuts), slice(lines, 1, 0), filter(slice(lines, cuts[k].a + 1, cuts[k].b - cuts[k].a), {SOLID.replace('x rlike', 'not x rlike')})))"
    kept = F.when(F.size("cuts") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.flatten(F.expr(f"transform(arrays_zip({between}, {blank}), z -> concat(z['0'], z['1']))")), "\n"))
    out = out.withColumn("kept", kept)
    return out.select(
        "doc_id",
        F.size("places").cast("long").alias("n_lines"),
        F.expr("aggregate(runs, 0L, (n, r) -> n + r.b - r.a + 1)").alias("n_removed"),
        F.size("runs").cast("long").alias("n_runs"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
        *([F.col("kept")] if keep_text else []),
    )
