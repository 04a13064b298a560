"""Near-duplicate components by bottom-k sketches.

One hash function orders all word 5-shingles. A document's sketch is its k least hashes.
Documents with equal shingle sets form a class, and only classes are compared. Inverted
lists of retained values bring together classes whose sketches overlap; the sketch of a
pair's union estimates its similarity and drops hopeless pairs; the rest is confirmed on the
full sets. Links are kept as components; copies are never expanded into pairs.

Which lists a class enters. Two sets with Jaccard similarity s share each of the k least
hashes of their union with chance s, so at 0.75 and k = 64 fewer than ``need`` = 27 shared
values have chance 1e-8. With the values in order of document frequency, two sketches
that share ``need`` values share one of the first size - need + 1 in both: a class
enters the lists of its rarest values only, and widespread passages make no long lists.
For sets of at most k shingles this holds without chance.

Long lists. Each list first compares its members with one head, the member with the most
widespread values, which is linear and joins a group of near copies to its centre; members
of long lists are compared with a second head, the member nearest to their common base.
What is left is settled without all pairs. Let the base B of a head's members be the head
with the values that many members share, I(z) the size of the intersection of z with B, and
A(z) the part of z outside B. Members z and x that share nothing outside B have an
intersection of at most min(I(z), I(x)); so a link needs min(I(z), I(x)) >= p / (1 + p) *
(|z| + |x|), which few pairs outside the head's component meet (found by an equi-join on
size), or a common value outside B. The latter makes the lists of the next level: the full
sets A, by head and value, each a tenth of the members at most. Lists of at most ``SMALL``
members (``NEXT_SMALL`` on later levels) compare members of different components directly.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import bound_batches, byte_slices, drop_table, materialize, raw_bytes, set_key, shingle_sets, text_binary, trimmed
from strandline.llm.components import connected_components

K = 64
#: The chance to miss a link at exactly the asked similarity.
MISS = 2e-8
SMALL = 24
NEXT_SMALL = 512


def needed_values(percent: int, k: int = K, miss: float = MISS) -> int:
    """The most shared values that two sketches of ``k`` can be asked for: with similarity
    ``percent`` they share fewer with a chance of at most ``miss``."""
    p, below, need = percent / 100, 0.0, 0
    while need < k and (below := below + math.comb(k, need) * p**need * (1 - p) ** (k - need)) <= miss:
        need += 1
    return need


def sketch_table(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, set_key and sketch (the k least hashes, ascending) of every row."""

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            for a, b in byte_slices(column):
                part = column.slice(a, b - a)
                keys, sizes, sketches = [], [], []
                for s in shingle_sets(*raw_bytes(part)):
                    sizes.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    sketches.append(s[:k])
                flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
                edges = np.concatenate(([0], np.cumsum([len(s) for s in sketches]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(edges, flat)], names=["doc_id", "n_shingles", "set_key", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_binary().alias("text")).mapInArrow(trimmed(run), "doc_id long, n_shingles long, set_key binary, sketch array<long>")


def _postings(classes: DataFrame, percent: int, need: int) -> DataFrame:
    """value, key, n, weight: the shared retained values that a class is listed under; the
    weight grows with the frequency of its values."""
    each = classes.select("set_key", "n_shingles", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    frequent = each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(frequent, "value")
    # values of one class only come first in the order; what is left of the prefix goes to the rarest shared ones
    by_class = shared.groupBy("set_key", "n_shingles", "size").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs"), (F.sum(F.log("df")) / F.first("size")).alias("weight"))
    room = f"cast(size(vs) + 1 - least({need}, ceil(n_shingles * {percent} / 100D)) as int)"
    return by_class.where(f"{room} > 0").select("set_key", "n_shingles", "weight", F.explode(F.expr(f"slice(vs, 1, {room})")).alias("p")).select(F.col("p.value").alias("value"), F.col("set_key").alias("key"), F.col("n_shingles").alias("n"), "weight")


def _hopeful(pairs: DataFrame, sketches: DataFrame, percent: int, k: int, need: int) -> DataFrame:
    """Pairs whose overlap in the sketch of their union allows the similarity."""
    joined = pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    overlap = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    floor = F.least(F.lit(need), F.ceil(F.least("na", "nb") * percent / 100))
    return joined.where(overlap >= floor).select("a", "b")


def _full_sets(postings: DataFrame, classes: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """set_key and hashes: the whole shingle sets of the classes in any list, from their texts."""
    wanted = postings.select(F.col("key").alias("set_key")).distinct().join(classes.select("set_key", "doc_id"), "set_key")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_binary().alias("text")).join(wanted, "doc_id").select("set_key", "text")

    def sets(batches):
        for batch in batches:
            column, keys = batch.column("text"), batch.column("set_key").to_pylist()
            for a, b in byte_slices(column):
                got = {k: s.tobytes() for k, s in zip(keys[a:b], shingle_sets(*raw_bytes(column.slice(a, b - a)))) if set_key(s) == k}
                yield pa.RecordBatch.from_arrays([pa.array(got.keys(), pa.binary()), pa.array(got.values(), pa.binary())], names=["set_key", "hashes"])

    out = texts.mapInArrow(trimmed(sets), "set_key binary, hashes binary")
    return out.dropDuplicates(["set_key"]) if repeated else out  # repeated ids may repeat sets


def _compared(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """a, b, inter, na, nb, linked and, where ``big``, the values of a outside b; on the full sets."""
    both = pairs.join(full.toDF("a", "ha"), "a").join(full.toDF("b", "hb"), "b").select("a", "b", "big", "ha", "hb")

    def check(batches):
        for batch in batches:
            ha, hb, big = batch.column("ha"), batch.column("hb"), batch.column("big").to_pylist()
            numbers, added = np.zeros((3, batch.num_rows), np.int64), []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.int64) for c in (ha, hb))
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = y[at] == x
                numbers[:, i] = int(common.sum()), len(x), len(y)
                added.append(x[~common] if big[i] else x[:0])
            inter, na, nb = numbers
            linked = 100 * inter >= percent * (na + nb - inter)
            edges = np.concatenate(([0], np.cumsum([len(x) for x in added]))).astype(np.int32)
            flat = np.concatenate(added) if added else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(x) for x in numbers), pa.array(linked), pa.ListArray.from_arrays(edges, flat)], names=["a", "b", "inter", "na", "nb", "linked", "added"])

    return both.mapInArrow(trimmed(check), "a binary, b binary, inter long, na long, nb long, linked boolean, added array<long>")


def _with_base(compared: DataFrame, small: int) -> DataFrame:
    """head, key, n, linked, inside and outside for compared members of long lists.

    The base of a head's members is the head with all values outside it that more than ``small``
    members and a tenth of them hold; ``inside`` counts a member's values in the base,
    ``outside`` lists the others. The head itself is a member. The bound holds for any base,
    and a value outside it makes a list of at most a tenth of the members.
    """
    own = compared.select(F.col("b").alias("head"), F.col("b").alias("key"), F.col("nb").alias("n"), F.col("nb").alias("inter"), F.lit(True).alias("linked"), F.array().cast("array<long>").alias("added")).dropDuplicates(["head"])
    member = compared.select(F.col("b").alias("head"), F.col("a").alias("key"), F.col("na").alias("n"), "inter", "linked", "added").dropDuplicates(["head", "key"]).union(own)
    size = member.groupBy("head").agg(F.count("*").alias("members"))
    each = member.select("head", "key", F.explode("added").alias("w"))
    common = each.groupBy("head", "w").agg(F.count("*").alias("c")).join(size, "head").where(F.col("c") > F.greatest(F.lit(small), F.col("members") / 10)).select("head", "w", F.lit(True).alias("hot"))
    told = each.join(common, ["head", "w"], "left").groupBy("head", "key").agg(F.count("hot").alias("more"), F.collect_list(F.when(F.col("hot").isNull(), F.col("w"))).alias("outside"))
    out = member.drop("added").join(told, ["head", "key"], "left")
    return out.select("head", "key", "n", "linked", (F.col("inter") + F.coalesce("more", F.lit(0))).alias("inside"), F.coalesce("outside", F.array().cast("array<long>")).alias("outside"))


def _similar_in_size(percent: int) -> str:
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def _components_of(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return lists.join(labels.toDF("key", "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))


def _links(docs: DataFrame, classes: DataFrame, percent: int, k: int, need: int, small: int, next_small: int, repeated: bool) -> DataFrame:
    """node, component of all linked classes."""
    sketches = classes.select("set_key", "sketch")
    lists = materialize(_postings(classes, percent, need), "near-postings")
    full = materialize(_full_sets(lists, classes, docs, repeated), "near-sets")
    links = docs.sparkSession.createDataFrame([], "a binary, b binary")
    labels = None
    for level in count():  # lists of a level have at most a tenth of the members of those before
        cap = small if level == 0 else next_small
        heads = lists.groupBy("value").agg(F.max_by(F.struct("key", "n"), F.struct("weight", "key")).alias("h"), F.count("*").alias("members"))
        long = not heads.where(F.col("members") > cap).isEmpty()
        if level == 0 or long:
            # every member with its list's head; on later levels in long lists only
            stars = lists.join(heads if level == 0 else heads.where(F.col("members") > cap), "value").where("key <> h.key")
            stars = stars.select(F.col("key").alias("a"), F.col("h.key").alias("b"), F.col("n").alias("na"), F.col("h.n").alias("nb"), (F.col("members") > cap).alias("big"))
            stars = materialize(stars.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("big").alias("big")), "near-stars")
            hopeful = _hopeful(stars.where("not big").where(_similar_in_size(percent)), sketches, percent, k, need).withColumn("big", F.lit(False))
            seen = materialize(_compared(hopeful.union(stars.where("big").select("a", "b", "big")), full, percent), "near-compared")
            links = materialize(links.union(seen.where("linked").select("a", "b")), "near-links")
            if long:
                # a second head for the members of a long list: the one nearest to their base
                member = _with_base(seen.join(stars.where("big").select("a", "b"), ["a", "b"]), small)
                nearest = member.groupBy("head").agg(F.max_by(F.col("key"), F.struct(F.col("inside") - F.size("outside"), "key")).alias("again"))
                again = member.select("head", "key").join(nearest, "head").where("key <> again").select(F.col("key").alias("a"), F.col("again").alias("b")).distinct().withColumn("big", F.lit(True))
                seen2 = materialize(_compared(again, full, percent), "near-compared")
                links = materialize(links.union(seen2.where("linked").select("a", "b")), "near-links")
                member = materialize(_with_base(seen2, small), "near-members")
                drop_table(seen2)
            labels = materialize(connected_components(links), "near-labels")
            drop_table(seen)

        # short lists: members of different components
        short = _components_of(lists.join(heads.where(F.col("members") <= cap), "value").select("value", "key", "n"), labels)
        mixed = short.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("value")
        short = materialize(short.join(mixed, "value"), "near-open")
        left, right = (short.select("value", F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}")) for x in "ab")
        cross = left.join(right, "value").where("a < b and ca <> cb").where(_similar_in_size(percent)).select("a", "b", "na", "nb").distinct()
        pairs = _hopeful(cross, sketches, percent, k, need)
        if not long:
            more = _compared(pairs.withColumn("big", F.lit(False)), full, percent)
            links = materialize(links.union(more.where("linked").select("a", "b")), "near-links")
            break

        # long lists: pairs that may meet within the base, by the size of the smaller partner
        out = member.where("not linked").withColumn("least_n", F.expr(f"cast(ceil(n * {percent} / 100D) as int)")).withColumn("most_n", F.expr(f"cast((inside * {100 + percent} div {percent}) - n as int)"))
        out = _components_of(out, labels).where("most_n >= least_n").select("head", F.col("key").alias("a"), F.col("n").alias("n1"), F.col("component").alias("c1"), F.explode(F.sequence("least_n", "most_n")).alias("n"))
        inner = _components_of(member, labels).select("head", F.col("key").alias("b"), F.col("n").cast("int").alias("n"), F.col("inside").alias("i2"), F.col("component").alias("c2"))
        within = out.join(inner, ["head", "n"]).where(f"a <> b and c1 <> c2 and i2 * {100 + percent} >= {percent} * (n1 + n)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = _compared(pairs.union(within).distinct().withColumn("big", F.lit(False)), full, percent)
        links = materialize(links.union(more.where("linked").select("a", "b")), "near-links")

        # and pairs that share a value outside the base: lists of the next level
        outside = _components_of(member, labels).select("key", "n", F.col("inside").cast("double").alias("weight"), F.explode("outside").alias("w"), "head", "component").select(F.xxhash64("head", "w").alias("value"), "key", "n", "weight", "component")
        mixed = outside.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("value")
        lists = materialize(outside.join(mixed, "value").select("value", "key", "n", "weight"), "near-lists")
        for table in (stars, short, member):
            drop_table(table)
    return connected_components(links)


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = K, small: int = SMALL, next_small: int = NEXT_SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable. Null, empty and word-less texts have no
    shingles and are their own component. Null ids join components through identical sets only
    and are never kept where the component has an id (component_id is null otherwise).
    Repeated rows give repeated results. Other columns are ignored. A low ``percent`` needs wide
    sketches (a greater ``k``); too narrow ones are refused.
    """
    need = needed_values(percent, k)
    if need < 1:
        raise ValueError(f"sketches of {k} values can't find all pairs of {percent} per cent")
    if next_small < small:
        raise ValueError("lists get shorter by level: next_small must be at least small")
    bound_batches(docs.sparkSession)
    table = materialize(sketch_table(docs, k), "near-sketch")
    classes = materialize(
        table.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")).where("doc_id is not null"),
        "near-classes",
    )
    repeated = not table.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    labels = _links(docs, classes, percent, k, need, small, next_small, repeated)
    of_class = classes.select("set_key", "doc_id").join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    smallest = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = of_class.join(smallest, "component").select("set_key", "component_id")
    out = table.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))
