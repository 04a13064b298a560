"""Hand-checked tables of the operators' semantics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.functions import text as T
from strandline.operators import graph as G
from strandline.operators import hamming as H
from strandline.operators import rows as R
from strandline.operators import sampling, structure, tensors
from strandline.operators import statistics as X
from strandline.operators.alignment import gotoh, matrix_rows, read_matrix
from strandline.operators.curves import compare_rocs
from strandline.operators.modelling import Component, FeatureSet, classify_feature, rebuild_out_of_fold

SEQ = "MKTAYIAKQRQISFVKSHFSRQ"


def one(spark, column, **values):
    names = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*names).select(column.alias("out")).first()["out"]


def test_flanks(spark):
    df = spark.createDataFrame([(SEQ, 3, 11), (SEQ, 14, 22)], "sequence string, start int, stop int")
    a, b = R.add_flanks(df, 5).orderBy("start").collect()
    assert (a.n_flank, a.c_flank, a.n_real, a.c_real, a.context) == ("XXXMK", "ISFVK", 2, 5, "XXXMKTAYIAKQRQISFVK")
    assert (b.n_flank, b.c_flank, b.n_real, b.c_real) == ("QRQIS", "XXXXX", 5, 0)
    assert one(spark, S.fraction("c", "X", 19), c=a.context) == pytest.approx(3 / 19)
    row = spark.range(1).select(*S.positions(F.lit("XXXMK"), F.lit("TAYIAKQRQ"), F.lit("ISF"), 5)).first()
    assert [row[f"N{i}"] for i in range(5, 0, -1)] == list("XXXMK") and row.C4 is None and row.P1 == "T"


def test_validate(spark):
    rows = [(1, "AABCAAB", "AAB", 1, 3), (2, "AABCAAB", "AAB", 2, 4), (3, "AABCAAB", "AAB", 9, 11), (4, "AABCAAB", "ZZ", 1, 2), (5, None, "AAB", 1, 3)]
    out = {r.k: r for r in R.validate_positions(spark.createDataFrame(rows, "k int, sequence string, peptide string, start int, stop int")).collect()}
    assert [out[i].status for i in range(1, 6)] == ["valid_original", "fixed", None, "unfixable", "no_protein_sequence"]
    assert (out[2].new_start, out[2].new_stop, out[2].shift) == (1, 3, -1)


def test_searches(spark):
    assert one(spark, S.find_all("s", "q"), s="AAAA", q="AA") == [1, 2, 3]
    assert one(spark, S.find_closest("s", "q", F.lit(2)), s="AAAA", q="AA") == 2
    assert one(spark, S.find_all("s", "q"), s="A", q="AA") == []
    assert len(one(spark, S.kmers("s"), s="ABCDEFGHIJ")) == 6
    assert one(spark, S.chunks(F.lit(2000))) == [0, 900, 1800]
    assert one(spark, S.at("s", F.lit(0), F.lit(2)), s="ABC") is None


def test_dedup_and_orphans(spark):
    rows = [(1, "a", 0), (2, "a", 1), (3, "a", 1), (4, "b", 0), (5, "b", 0), (6, "c", 1), (7, None, 0), (8, None, 1)]
    df = spark.createDataFrame(rows, "row_id long, context string, label int")
    assert sorted(r.row_id for r in R.window_dedup(df).collect()) == [2, 4, 6, 8]
    rows = [(1, "p1", 1), (2, "p1", 0), (3, "p2", 0), (4, "p2", 0)]
    df = spark.createDataFrame(rows, "row_id long, protein string, label int")
    assert sorted(r.row_id for r in R.drop_orphans(df, "protein").collect()) == [1, 2]


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(1, None, 2), (2, "x", None)], "row_id int, k string, j int")
    b = spark.createDataFrame([(None, 2, "u"), ("x", None, "v")], "k string, j int, v string")
    assert {r.row_id: r.v for r in R.null_safe_join(a, b, ["k", "j"]).collect()} == {1: "u", 2: "v"}


def test_checked_join_fails_on_a_missing_key(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no match"):
        R.checked_join(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="repeats"):
        R.checked_join(a.where("k = 1"), b.union(b), ["k"]).collect()


def test_bins(spark):
    values = [0.0, 0.5, 0.5001, 2.0, 2.1]
    df = spark.createDataFrame([(v,) for v in values], "r double").select("r", T.closed_bin("r", 4).alias("b"))
    assert [r.b for r in df.orderBy("r").collect()] == [1, 1, 2, 4, None]


def test_sampling_plan(spark):
    pos = spark.createDataFrame([(b,) for b, n in ((1, 6), (2, 2), (3, 2)) for _ in range(n)], "bin int")
    can = spark.createDataFrame([(b,) for b, n in ((1, 9), (2, 1), (3, 8)) for _ in range(n)], "bin int")
    got = {r.bin: (r.max_n, r.n_sample) for r in sampling.plan(pos, can).collect()}
    assert got == {1: (5, 3), 2: (5, 1), 3: (5, 1)}


def test_two_sample(spark):
    df = spark.createDataFrame([(v, 1) for v in (0.1, 0.2, 0.3)] + [(v, 0) for v in (0.2, 0.4)], "v double, g int")
    r = X.two_sample(df, "v", "g").first()
    assert r.ks == pytest.approx(0.5) and r.delta == pytest.approx(-0.5) and r.magnitude == "large" and r.cles == pytest.approx(0.25)


def test_areas(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.4), (3, 0, 0.4), (4, 0, 0.1)], "row_id int, y int, p double").withColumn("q", F.col("p"))
    assert X.auc(df, "p", "y").first()["auc"] == pytest.approx(0.875)
    assert X.average_precision(df, "p", "y").first()[0] == pytest.approx(0.8333333333)
    v = {r.row_id: r.v_p for r in X.delong_components(df, ["p"], "y").collect()}
    assert [v[i] for i in (1, 2, 3, 4)] == [1.0, 0.75, 0.75, 1.0]
    assert X.auc(df.where("y = 1"), "p", "y").first()["auc"] is None


def test_adjustments(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "k int, p double")
    bh = {r.k: r.p_adj for r in X.adjust(df, "p", "bh").collect()}
    holm = {r.k: r.p_adj for r in X.adjust(df, "p", "holm").collect()}
    assert [bh[i] for i in (1, 2, 3)] == pytest.approx([0.03, 0.04, 0.04]) and bh[4] is None
    assert [holm[i] for i in (1, 2, 3)] == pytest.approx([0.03, 0.06, 0.06])


def test_normal_p(spark):
    import math

    for z in (0.0, 1.0, 1.96, -2.5, 4.0):
        assert one(spark, X.normal_p(F.lit(z))) == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=3e-7)


def test_small_distributions():
    assert X.t_p_value(2.015, 5) == pytest.approx(0.1, abs=1e-3)
    assert X.fisher_p(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-5)
    assert X.fisher_p(8, 2, 1, 5) == pytest.approx(0.034965, abs=1e-5)
    a = np.random.default_rng(0).normal(size=(10, 3))
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    assert X.kabsch_rmsd(a, a @ turn + 5) == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("d", range(1, 8))
def test_hamming_join(spark, d):
    rng = np.random.default_rng(d)
    strings = sorted({"".join(rng.choice(list("ABC"), 9)) for _ in range(60)})
    got = {(r.a, r.b, r.distance) for r in H.close_pairs(spark.createDataFrame([(s,) for s in strings], "s string"), "s", 9, d).collect()}
    ham = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert got == {(a, b, ham(a, b)) for i, a in enumerate(strings) for b in strings[i + 1 :] if ham(a, b) <= d}


@pytest.mark.parametrize("letters", ["ABCDEFGHIJ", "AÉ😀"])
@pytest.mark.parametrize("d", [1, 4, 5, 9, 19])
def test_hamming_join_of_long_strings(spark, monkeypatch, d, letters):
    monkeypatch.setattr(H, "AT_ONCE", 1000)  # in rounds
    rng = np.random.default_rng(d)
    strings = {"".join(rng.choice(list(letters), 19)) for _ in range(40)}
    for s in sorted(strings)[:15]:
        for n in (1, d, d + 1):
            at = set(rng.choice(19, min(n, 19), replace=False).tolist())
            strings.add("".join(rng.choice(list(letters)) if i in at else x for i, x in enumerate(s)))
    strings = sorted(strings)
    df = spark.createDataFrame([(s,) for s in [*strings, strings[0], "A", None]], "s string")
    got = [(r.a, r.b, r.distance) for r in H.close_pairs(df, "s", 19, d).collect()]
    ham = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert sorted(got) == [(a, b, ham(a, b)) for i, a in enumerate(strings) for b in strings[i + 1 :] if ham(a, b) <= d]


def test_keys_are_rare():
    """A key takes eight symbols where 64 keys allow it: common words of a few letters are no keys."""
    for d in range(1, 5):
        k, r = H.blocks_of(19, d)
        assert k == d + r and sum(hi - lo for lo, hi in sorted(H.block_bounds(19, d, k), key=lambda b: b[1] - b[0])[:r]) >= 6
    assert H.blocks_of(19, 5) == (8, 3) and H.blocks_of(9, 1) == (9, 8) and H.blocks_of(9, 9)[1] == 0


def test_blocks():
    assert [len(H.block_bounds(19, d)) for d in range(2, 10)] == [3, 3, 3, 3, 4, 4, 5, 5]
    assert H.block_bounds(19, 6) == [(0, 4), (4, 9), (9, 14), (14, 19)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (200, 200)]
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 41), 100, 101, 102, 200, 300]], "node long")
    out = {r.node: r.component for r in G.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 1 for i in range(1, 41)) and out[102] == out[101] == 100 and out[200] == 200 and out[300] == 300


def test_packing():
    sizes = [5, 4, 3, 3, 2, 1]
    got = G.balanced_partition([(n, i, i) for i, n in enumerate(sizes)], 3)
    assert [got[i] for i in range(6)] == [0, 1, 2, 2, 1, 0]


def test_shared_flank_joins(spark):
    df = spark.createDataFrame([("AAAAABBBBBBBBBCCCCC", "BBBBBBBBB"), ("AAAAADDDDDDDDDEEEEE", "DDDDDDDDD"), ("FFFFFGGGGGGGGGHHHHH", "GGGGGGGGG")], "context string, peptide string")
    got = {r.node: r.component for r in G.context_clusters(df, distance=1).collect()}
    assert got["AAAAADDDDDDDDDEEEEE"] == "AAAAABBBBBBBBBCCCCC" and got["FFFFFGGGGGGGGGHHHHH"] == "FFFFFGGGGGGGGGHHHHH"


def test_regions_and_pools(spark):
    v = F.array(F.lit(0.2), F.lit(0.4))
    assert one(spark, tensors.imputed_mean(v, 5, "left")) == pytest.approx(0.24)
    assert one(spark, tensors.imputed_mean(v, 5, "right")) == pytest.approx(0.36)
    none = F.array().cast("array<double>")
    assert one(spark, tensors.imputed_mean(none, 5, "left", F.lit(0.7))) == pytest.approx(0.7)
    assert one(spark, tensors.imputed_mean(none, 5, "left")) is None
    df = spark.createDataFrame([(1, [[1.0], [3.0], [9.0]], [False, False, True]), (2, [[1.0], [3.0], [9.0]], [True, True, True])], "row_id long, window array<array<double>>, pad_mask array<boolean>")
    mean = {r.row_id: r.pooled[0] for r in tensors.pool(df, "mean").collect()}
    assert mean[1] == 2.0 and mean[2] == pytest.approx(13 / 3)
    assert {r.row_id: r.pooled[0] for r in tensors.pool(df, "mean", masked=False).collect()}[1] == pytest.approx(13 / 3)
    assert {r.row_id: r.pooled[0] for r in tensors.pool(df, "max").collect()}[1] == 3.0
    assert tensors.variance_by_dimension(df).first()["variance"] == 1.0


def probabilities(text):
    return [[1.0 if s == c else 0.0 for s in structure.STATES] for c in text]


def regions(spark, rows, size):
    """Probability rows split into flanks of ``size`` and the peptide between."""
    data = [(i, p[:size], p[size : len(p) - size], p[len(p) - size :]) for i, p in enumerate(rows)]
    return spark.createDataFrame(data, "i int, n array<array<double>>, pep array<array<double>>, c array<array<double>>")


def test_structure_flags(spark):
    df = regions(spark, [probabilities("CCCHHHHHHHHHEEEECCC")], 5)
    got = structure.with_features(df, "n", "pep", "c", 5).first().asDict()
    on = {k for k in structure.FEATURES if got[k]}
    assert on == {"q8point_C_nflank", "q8point_H_nflank", "q8point_H_peptide", "q8point_E_peptide", "q8point_E_cflank", "q8point_C_cflank", "q8trans_H_n_pep", "q8trans_E_pep_c"}


def test_structure_rescue(spark):
    rows = []
    for likely in (0.45, 0.39):
        p = probabilities("CCHHHCC")
        p[1] = [0.0] * 8
        p[1][structure.STATES.index("H")], p[1][structure.STATES.index("C")] = likely, 1 - likely
        rows.append((len(rows), p))
    df = spark.createDataFrame(rows, "i int, p array<array<double>>")
    held = {r.i: [tuple(x) for x in r.held] for r in structure.with_accepted(df, "p", "held").collect()}
    assert ("H", 2, 5) in held[0] and not any(v == "H" for v, _, _ in held[1])


def test_structure_against_brute_force(spark):
    """Offers are weighed one by one here: the most demanding, then the likeliest, then the leftmost."""
    rng = np.random.default_rng(8)
    rows = [rng.dirichlet([0.4] * 8, 12).round(3).tolist() for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, p array<array<double>>")
    for r in structure.with_accepted(df, "p", "held").collect():
        p = np.array(rows[r.i])
        text = "".join(structure.STATES[k] for k in p.argmax(axis=1)) + "|"
        runs, at = [], 0
        for k in range(1, len(text)):
            if text[k] != text[at]:
                runs.append((text[at], at + 1, k))
                at = k
        want = [x for x in runs if x[2] - x[1] + 1 >= structure.LEAST_RUN[x[0]]]
        own = {x[0] for x in want}
        open_ = [(s, a, b, q) for s, a, b in runs if s not in own and b - a + 2 == structure.LEAST_RUN[s] for q in (a - 1, b + 1) if 1 <= q <= 12 and p[q - 1, structure.STATES.index(s)] >= structure.RESCUE]
        while open_:
            best = max(open_, key=lambda o: (structure.LEAST_RUN[o[0]], p[o[3] - 1, structure.STATES.index(o[0])], -o[1], -o[3]))
            want.append((best[0], min(best[1], best[3]), max(best[2], best[3])))
            open_ = [o for o in open_ if o[0] != best[0] and o[3] != best[3]]
        assert [tuple(x) for x in r.held] == want


def test_features_complete_the_flanks(spark):
    p = probabilities("HHHHHHHHH")
    data = [(0, [], p, p[:2]), (1, p[:1], [], p[:1])]
    got = structure.with_features(spark.createDataFrame(data, "i int, n array<array<double>>, pep array<array<double>>, c array<array<double>>"), "n", "pep", "c", 5).orderBy("i").collect()
    assert got[0].q8trans_H_n_pep == 1 and got[0].q8trans_H_pep_c == 1 and got[1].q8point_H_peptide is None


def test_runs(spark):
    assert [tuple(r) for r in one(spark, structure.run_table("s"), s="HHHCCE")] == [("H", 1, 3, 3), ("C", 4, 5, 2), ("E", 6, 6, 1)]


def plain_gap(y, a, b, steps=1000):
    def heights(s):
        spots = [(0.0, 0.0)] + [(sum(y[s >= t] == 0) / sum(y == 0), sum(y[s >= t] == 1) / sum(y == 1)) for t in sorted(set(s), reverse=True)]
        return np.interp(np.arange(steps + 1) / steps, *zip(*spots))

    return heights(a) - heights(b)


def test_roc_comparison(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(4):
        y = rng.integers(0, 2, 150)
        a = np.round(y * rng.normal(0.6, 1, 150) + rng.normal(0, 1, 150), 1)
        b = a.copy() if g == 0 else np.round(y * 0.5 + rng.normal(0, 1, 150), 1)
        rows += [(150 * g + i, g, int(y[i]), float(a[i]), float(b[i])) for i in range(150)]
        gap = plain_gap(y, a, b)
        inner = [k for k in range(11, 990) if abs(gap[k]) >= 0.002]
        want[g] = (sum(gap[i] * gap[j] < 0 for i, j in zip(inner, inner[1:])), max(abs(gap[11:990])), gap)
    df = spark.createDataFrame(rows, "row_id long, g int, y int, a double, b double")
    got = {r.g: r for r in compare_rocs(df, "a", "b", "y", ["g"]).collect()}
    for g, (crossings, widest, gap) in want.items():
        r = got[g]
        assert r.crossings == crossings == len(r.crossing_at) and r.max_gap == pytest.approx(widest, abs=1e-9)
        assert r.verdict == ("crossing" if crossings else "near_identical" if widest < 0.002 else "clean")
        lost = [k for k in range(11, 990) if abs(gap[k]) >= 0.002 and gap[k] * r.delta < 0]
        assert r.disagree_range == pytest.approx(len(lost) / 1000) and r.max_flip == pytest.approx(max((abs(gap[k]) for k in lost), default=0), abs=1e-9)
    assert got[0].verdict == "near_identical" and got[0].tier == "clean"


def test_alignment():
    score, a, b = gotoh("ACGTT", "ACTT")
    assert a.replace("-", "") == "ACGTT" and b.replace("-", "") == "ACTT" and score == 10.0 and b.count("-") == 1
    m = read_matrix("# x\n   A  C\nA  4 -1\nC -1  5\n")
    assert m["A", "C"] == -1 and gotoh("AC", "AC", m)[0] == 9


def test_feature_sets():
    with pytest.raises(ValueError):
        FeatureSet([Component("blosum45", "csv"), Component("blosum90", "csv")]).check()
    f = FeatureSet([Component("a", "csv", prefixes=["N1_"]), Component("h", "csv", columns=["z"])]).check()
    assert f.resolve(["id", "N1_A", "z", "y"], ["id"]) == ["N1_A", "z"]


def test_out_of_fold_guards(spark):
    rows = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "row_id long, fold int, y int")
    runs = spark.createDataFrame([(0, [(0.5, 1)])], "fold int, scores array<struct<y_prob: double, y_true: int>>")
    with pytest.raises(Exception, match="another length"):
        rebuild_out_of_fold(rows, runs).collect()


def test_ledger_and_cascade(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "k int, v int")
    out = {r.k: (r.low, r.high, r.excluded, r.reason) for r in R.ledger(df, {"low": F.col("v") < 10, "high": F.col("v") > 40}).collect()}
    assert out == {1: (True, False, True, "low"), 2: (False, True, True, "high"), 3: (False, False, False, None)}
    steps = {r.stage: r.rows for r in R.cascade(df, {"all": F.lit(True), "known": F.col("v").isNotNull(), "high": F.col("v") > 40}).collect()}
    assert steps == {"all": 3, "known": 2, "high": 1}


def test_stream(spark, tmp_path):
    from strandline.streaming import stream_windows

    spark.createDataFrame([(SEQ, 3, 11)], "sequence string, start int, stop int").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("sequence string, start int, stop int").parquet(str(tmp_path / "in"))
    stream_windows(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().context == "XXXMKTAYIAKQRQISFVK"


def test_kmers_of_long_sequences(spark):
    text = "".join("ACDEFGHIKLMNPQRSTVWY"[(i * i + 3 * i) % 20] for i in range(150))
    df = spark.createDataFrame([(1, text), (2, "ABC"), (3, None)], "id int, s string")
    got = sorted((r.id, r.start, r.n, r.kmer) for r in R.kmers(df, "s", 3, 5, block=16).collect())
    want = [(i, a + 1, n, t[a : a + n]) for i, t in ((1, text), (2, "ABC")) for a in range(len(t)) for n in (3, 4, 5) if a + n <= len(t)]
    assert got == sorted(want)


def test_permuted_labels_keep_their_number(spark):
    df = spark.range(300).select(F.col("id").alias("row"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = sampling.permuted_ones(df, "y", "row", 20, buckets=8).collect()
    by = {}
    for r in got:
        by.setdefault(r.rep, set()).add(r.row)
    assert sorted(by) == list(range(1, 21)) and all(len(s) == 100 for s in by.values()) and len(got) == 2000
    assert len({frozenset(s) for s in by.values()}) == 20
    assert sampling.permuted_ones(df.where("y = 0"), "y", "row", 3).count() == 0


def test_random_windows_are_as_many_as_asked(spark):
    assert sampling.random_windows(spark, 60, 2, alphabet="ACDEFGHK").count() == 60
    with pytest.raises(ValueError):
        sampling.random_windows(spark, 65, 2, alphabet="ACDEFGHK")


def test_windows_cut_in_the_row(spark):
    text = "".join("ACDEFGHIKLMNPQRSTVWY"[(i * 7 + i // 5) % 20] for i in range(103))
    df = spark.createDataFrame([(text,), ("ACDEFGHI",), ("",)], "sequence string").withColumn("len", F.length("sequence"))
    got = sorted(tuple(r) for r in R.complete_flanks(R.cut_windows(df, "sequence", 9, 40, 5), 5).select("start", "peptide", "context", "n_real", "c_real").collect())
    spots = spark.createDataFrame([(text, s, s + 8) for s in (1, 41, 81)], "sequence string, start int, stop int")
    want = R.add_flanks(spots, 5).withColumn("peptide", F.expr("substring(sequence, start, 9)")).select("start", "peptide", "context", "n_real", "c_real").collect()
    assert got == sorted(map(tuple, want))


def test_feature_kinds(spark):
    names = ["N1_A", "P9_AF1", "P10_A", "N1_a_b", "esmc_PC3", "x_PC1", "frac_A", "mean_rsa_peptide"]
    got = [one(spark, classify_feature(F.lit(n))) for n in names]
    assert got == ["aa_encoding", "aa_encoding", "handcrafted", "handcrafted", "embedding_pca", "embedding_pca", "handcrafted", "handcrafted"]


def test_early_stop(spark):
    curves = {"a": [1, 2, 3, 2, 2, 2, 9], "b": [1.0, 2, 3], "c": [5.0], "d": [3, 3, 3, 3, 3], "e": [None, 2.0, 1.0]}
    rows = [(k, i, None if v is None else float(v)) for k, c in curves.items() for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "curve string, step int, v double")
    up = {r["curve"]: (r["stop_round"], r["best_round"]) for r in X.early_stop(df, "curve", "step", "v", 3).collect()}
    assert up == {"a": (6, 3), "b": (3, 3), "c": (1, 1), "d": (4, 1), "e": (2, 1)}
    down = {r["curve"]: (r["stop_round"], r["best_round"]) for r in X.early_stop(df, "curve", "step", "v", 3, False).collect()}
    assert down == {"a": (4, 1), "b": (3, 1), "c": (1, 1), "d": (4, 1), "e": (2, 2)}


def test_linkage_order():
    d = np.array([[0, 9, 1, 8], [9, 0, 7, 2], [1, 7, 0, 6], [8, 2, 6, 0]], float)
    assert X.linkage_order(list("abcd"), d) == ["a", "c", "b", "d"]
    assert X.linkage_order(["x"], np.zeros((1, 1))) == ["x"] and X.linkage_order([], np.zeros((0, 0))) == []


def test_all_positions(spark):
    got = one(spark, S.encode_all(F.split(F.lit("AZX"), ""), S.ATCHLEY))
    assert got == [*S.ATCHLEY["A"], *[0.0] * 10] and len(S.KIDERA) == 20 and {len(v) for v in S.KIDERA.values()} == {10}
    assert one(spark, S.encode_all(F.array(F.lit("C"), F.lit(None).cast("string")), S.one_hot_table())) == [0.0, 1.0, *[0.0] * 40]


def test_precision_and_recall(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0), (None, 1)], "s double, y int")
    got = sorted((r["threshold"], round(r["precision"], 6), r["recall"]) for r in X.pr_curve(df, "s", "y").collect())
    assert got == [(0.1, 0.5, 1.0), (0.8, 0.666667, 1.0), (0.9, 1.0, 0.5)]


def test_substitution_rows(spark):
    table = matrix_rows(read_matrix("# made up\n   A  C  X\nA  4 -1  0\nC -1  9 -2\nX  0 -2 -1\n"), "ACX")
    assert one(spark, S.encode_all(F.split(F.lit("CZX"), ""), table)) == [-1.0, 9.0, -2.0, 0.0, 0.0, 0.0, 0.0, -2.0, -1.0]
    with pytest.raises(ValueError):
        matrix_rows(read_matrix("   A  C\nA  4 -1\nC  0  9\n"), "AC")
