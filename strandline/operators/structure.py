"""Secondary-structure features of a window from probabilities of eight states a position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: states in order, least run of each, probability that rescues a run one short
STATES = "HGIEBTSC"
LEAST_RUN = {"H": 4, "G": 3, "I": 5, "E": 2, "B": 1, "T": 2, "S": 1, "C": 1}
RESCUE = 0.4
REGIONS = ("peptide", "nflank", "cflank")
FEATURES = [f"q8point_{s}_{r}" for r in REGIONS for s in STATES] + [f"q8trans_{s}_{t}" for t in ("n_pep", "pep_c") for s in STATES]


def _padded(block: str, edge: Column, size: int, left: bool) -> Column:
    """A region brought to ``size`` positions by repeating its outer end, or ``edge`` where it is empty."""
    own = F.coalesce(F.col(block), F.array().cast("array<array<double>>"))
    end = F.get(own, F.lit(0)) if left else F.get(own, F.size(own) - 1)
    more = F.array_repeat(F.coalesce(end, edge), F.greatest(F.lit(0), size - F.size(own)))
    return F.concat(more, F.slice(own, 1, size)) if left else F.concat(F.slice(own, 1, size), more)


def accepted_runs(states: Column, runs: Column, probabilities: Column, rescue: float = RESCUE) -> Column:
    """Runs (value, first, last) that hold: those of the least length, and those one short that a
    neighbouring place completes whose probability of the state reaches ``rescue``.

    Only states without a run of their own are completed, each once, and a place completes one
    run. Offers are ranked by the length that the state demands, then the probability, then from
    left to right; an offer is taken unless one taken before it has its state or its place.
    """
    demand = F.create_map(*[F.lit(x) for s, n in LEAST_RUN.items() for x in (s, n)])
    holds = F.filter(runs, lambda r: r["length"] >= demand[r["value"]])
    short = F.filter(runs, lambda r: (r["length"] == demand[r["value"]] - 1) & ~F.exists(holds, lambda h: h["value"] == r["value"]))

    def offer(r: Column, place: Column, side: int) -> Column:
        chance = F.get(F.get(probabilities, place - 1), F.array_position(states, r["value"]).cast("int") - 1)
        return F.struct((-demand[r["value"]]).alias("rank"), (-chance).alias("unlikely"), r["first"].alias("at"), F.lit(side).alias("side"), place.alias("place"), r["value"].alias("value"), F.least(place, r["first"]).alias("first"), F.greatest(place, r["last"]).alias("last"))

    offers = F.flatten(F.transform(short, lambda r: F.array(offer(r, r["first"] - 1, 0), offer(r, r["last"] + 1, 1))))
    offers = F.array_sort(F.filter(offers, lambda o: -o["unlikely"] >= rescue))
    none = F.slice(offers, 1, 0)
    taken = F.aggregate(offers, none, lambda had, o: F.when(F.exists(had, lambda x: (x["value"] == o["value"]) | (x["place"] == o["place"])), had).otherwise(F.concat(had, F.array(o))))
    plain = lambda rs: F.transform(rs, lambda r: F.struct(r["value"].alias("value"), r["first"].alias("first"), r["last"].alias("last")))
    return F.concat(plain(holds), plain(taken))


def with_accepted(df: DataFrame, probabilities: str, out: str) -> DataFrame:
    """``accepted_runs`` of a column of probability rows by position."""
    states = F.array(*[F.lit(s) for s in STATES])
    likeliest = F.array_join(F.transform(probabilities, lambda x: F.element_at(states, F.array_position(x, F.array_max(x)).cast("int"))), "")
    # each step is a column of its own: within a function an expression would be worked out anew for each element
    df = df.withColumn("_states", likeliest).withColumn("_runs", run_table("_states"))
    held = F.when(F.col(probabilities).isNotNull(), accepted_runs(states, F.col("_runs"), F.col(probabilities)))
    return df.withColumn(out, held).drop("_states", "_runs")


def with_features(df: DataFrame, n: str, peptide: str, c: str, flank: int) -> DataFrame:
    """The flags as columns, from arrays of probability rows of the three regions; null without a
    peptide region. Flanks are completed first: with their own edge, or the peptide's next position."""
    first, last = F.get(peptide, F.lit(0)), F.get(peptide, F.size(peptide) - 1)
    whole = F.concat(_padded(n, first, flank, True), F.col(peptide), _padded(c, last, flank, False))
    df = df.withColumn("_all", F.when(F.size(peptide) > 0, whole)).withColumn("_end", F.size(peptide) + flank)
    df = with_accepted(df, "_all", "_held")
    limits = {"nflank": (F.lit(1), F.lit(flank)), "peptide": (F.lit(flank + 1), F.col("_end")), "cflank": (F.col("_end") + 1, F.col("_end") + flank)}

    def flag(state: str, *regions: str) -> Column:
        """Whether a run of the state meets all of the regions."""
        meets = lambda r: reduce(lambda x, y: x & y, [(r["first"] <= limits[g][1]) & (r["last"] >= limits[g][0]) for g in regions])
        return F.exists("_held", lambda r: (r["value"] == state) & meets(r)).cast("int")

    flags = [flag(s, r) for r in REGIONS for s in STATES] + [flag(s, "peptide", g) for g in ("nflank", "cflank") for s in STATES]
    return df.withColumns(dict(zip(FEATURES, flags))).drop("_all", "_end", "_held")


def run_table(text: Column | str) -> Column:
    """W09 as a column: runs of equal symbols as structs (value, first, last, length)."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.length(text)
    at = lambda i: F.substring(text, i, F.lit(1))
    spots = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(spots, lambda i: (i == 1) | (at(i) != at(i - 1)))
    ends = F.filter(spots, lambda i: (i == n) | (at(i) != at(i + 1)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(at(a).alias("value"), a.alias("first"), b.alias("last"), (b - a + 1).alias("length")))
