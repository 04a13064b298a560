"""Projection, filter and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.functions import text as T
from strandline.operators import rows as R
from strandline.operators import structure, tensors
from strandline.operators.sampling import hash_sample, random_windows
from strandline.plans.base import OBS, PROT, WIN, observations, proteins, table, windows
from strandline.plans.registry import query


@query(f"""WITH {WIN}, r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY label DESC, row_id) AS rn FROM win)
SELECT row_id, context, label, n_real, c_real FROM r WHERE rn = 1""")
def flagship_windows(spark, sf):
    """Window extraction and conflict-aware dedup."""
    return R.window_dedup(windows(spark, sf)).select("row_id", "context", "label", "n_real", "c_real")


@query("""SELECT doc_id, coalesce(nullif(regexp_extract(a, 'uniprot/([A-Z0-9]+(?:-[0-9]+)?)', 1), ''), nullif(regexp_extract(b, 'uniprot/([A-Z0-9]+(?:-[0-9]+)?)', 1), '')) AS accession FROM
(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'http://x.org/uniprot/P' || (10000 + doc_id) || '-2' ELSE source END AS a, CASE WHEN doc_id % 3 = 1 THEN 'u/uniprot/Q' || doc_id ELSE NULL END AS b FROM documents)""")
def p01_accession(spark, sf):
    d = table(spark, sf, "documents")
    d = d.select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'http://x.org/uniprot/P' || (10000 + doc_id) || '-2' ELSE source END").alias("a"), F.expr("CASE WHEN doc_id % 3 = 1 THEN 'u/uniprot/Q' || doc_id END").alias("b"))
    return d.select("doc_id", T.accession("a", "b").alias("accession"))


@query("""SELECT doc_id, split_part(h, '|', 2) AS acc, regexp_matches(split_part(h, '|', 2), '-[0-9]+$') AS isoform, split_part(replace(h, '|', '_'), '_', 2) AS token
FROM (SELECT doc_id, 'sp|P' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '-1' ELSE '' END || '|' || source AS h FROM documents)""")
def p02_p03_headers(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr("'sp|P' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '-1' ELSE '' END || '|' || source").alias("h"))
    return d.select("doc_id", T.header_accession("h").alias("acc"), T.is_isoform(T.header_accession("h")).alias("isoform"), F.split_part(F.replace("h", F.lit("|"), F.lit("_")), F.lit("_"), F.lit(2)).alias("token"))


@query("SELECT p_partkey AS partkey, p_name AS name, p_size AS size FROM part")
def p04_strip_prefix(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    return d.withColumnsRenamed({c: c.removeprefix("p_") for c in d.columns})


@query(f"WITH {OBS} SELECT row_id, CASE WHEN rank < 0.5 THEN 'SB' WHEN rank < 2 THEN 'WB' ELSE 'NB' END AS binder, CASE WHEN label = 1 THEN 'Positive' ELSE 'Negative' END AS class FROM obs")
def p05_p23_classes(spark, sf):
    return observations(spark, sf).select("row_id", T.binder_class("rank").alias("binder"), F.when(F.col("label").isin(1), "Positive").otherwise("Negative").alias("class"))


@query(f"""WITH {OBS} SELECT row_id, CASE WHEN s >= 1 AND s + 8 <= len THEN substr(sequence, s, 9) END AS span, nullif(strpos(sequence, substr(peptide, 1, 4)), 0)::INT AS first_at
FROM (SELECT *, start - 20 AS s FROM obs)""")
def p06_p07_spans(spark, sf):
    o = observations(spark, sf).withColumn("s", F.col("start") - 20)
    return o.select("row_id", S.at("sequence", F.col("s"), F.col("s") + 8).alias("span"), S.find_first("sequence", F.substring("peptide", 1, 4)).alias("first_at"))


@query(f"""WITH {PROT}, c AS (SELECT doc_id, len, unnest(string_split(sequence, '')) AS a, generate_subscripts(string_split(sequence, ''), 1) AS i FROM prot),
t AS (SELECT doc_id, len, i, a || lead(a, 1, '') OVER w || lead(a, 2, '') OVER w AS g FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)), hits AS (SELECT * FROM t WHERE g = 'THE')
SELECT p.doc_id, count(i)::INT AS n, arg_min(i, abs(i - p.len // 2) * 10000000 + i)::INT AS closest FROM prot p LEFT JOIN hits h USING (doc_id) GROUP BY p.doc_id""")
def p08_closest(spark, sf):
    p = proteins(spark, sf)
    return p.select("doc_id", F.size(S.find_all("sequence", F.lit("THE"))).alias("n"), S.find_closest("sequence", F.lit("THE"), F.expr("len div 2")).cast("int").alias("closest"))


@query(f"""WITH {OBS}, o AS (SELECT row_id, CASE WHEN row_id % 7 = 0 THEN NULL ELSE sequence END AS sequence, len, CASE WHEN row_id % 5 = 0 THEN 'QQQQQQQQQ' ELSE peptide END AS peptide,
  CASE WHEN row_id % 3 = 0 THEN start + 1 WHEN row_id % 11 = 0 THEN NULL ELSE start END AS start FROM obs),
v AS (SELECT *, CASE WHEN start >= 1 AND start + 8 <= length(sequence) THEN substr(sequence, start, 9) END AS span, nullif(strpos(sequence, peptide), 0) AS found FROM o),
s AS (SELECT *, CASE WHEN sequence IS NULL THEN 'no_protein_sequence' WHEN span = peptide THEN 'valid_original' WHEN span <> peptide AND found IS NOT NULL THEN 'fixed' WHEN span <> peptide AND found IS NULL THEN 'unfixable' END AS status FROM v)
SELECT row_id, status, CASE WHEN status = 'fixed' THEN found ELSE start END::INT AS new_start, CASE WHEN status = 'fixed' THEN found - start END::INT AS shift FROM s""")
def p09_validate(spark, sf):
    o = observations(spark, sf)
    o = o.withColumn("sequence", F.expr("CASE WHEN row_id % 7 <> 0 THEN sequence END")).withColumn("peptide", F.expr("CASE WHEN row_id % 5 = 0 THEN 'QQQQQQQQQ' ELSE peptide END"))
    o = o.withColumn("start", F.expr("CASE WHEN row_id % 3 = 0 THEN start + 1 WHEN row_id % 11 = 0 THEN NULL ELSE start END")).withColumn("stop", F.col("start") + 8)
    return R.validate_positions(o).select("row_id", "status", "new_start", "shift")


@query(f"WITH {WIN} SELECT row_id, n_flank, c_flank, n_real, c_real, context, round(rel_n, 9) AS rel_n, round(rel_c, 9) AS rel_c FROM win")
def p10_p13_flanks(spark, sf):
    return windows(spark, sf).select("row_id", "n_flank", "c_flank", "n_real", "c_real", "context", F.round("rel_n", 9).alias("rel_n"), F.round("rel_c", 9).alias("rel_c"))


@query(f"""WITH {OBS}, f AS (SELECT *, nullif(strpos(sequence, peptide), 0) AS a FROM obs)
SELECT row_id, a IS NOT NULL AS found, substr(sequence, greatest(1, a - 8), a - greatest(1, a - 8)) AS n_flank, substr(sequence, a + 9, 8) AS c_flank FROM f""")
def p11_flanks_by_search(spark, sf):
    o = observations(spark, sf).withColumn("at", S.find_first("sequence", "peptide"))
    return o.select("row_id", F.col("at").isNotNull().alias("found"), S.left_flank("sequence", "at", 8).alias("n_flank"), S.right_flank("sequence", F.col("at") + 8, 8).alias("c_flank"))


_P12 = ", ".join([f"CASE WHEN length(raw_n) >= {i} THEN substr(raw_n, length(raw_n) - {i - 1}, 1) END AS N{i}" for i in range(5, 0, -1)] + [f"substr(peptide, {i}, 1) AS P{i}" for i in range(1, 10)] + [f"CASE WHEN length(raw_c) >= {i} THEN substr(raw_c, {i}, 1) END AS C{i}" for i in range(1, 6)])


@query(f"WITH {WIN} SELECT row_id, {_P12} FROM win")
def p12_positions(spark, sf):
    o = observations(spark, sf)
    return o.select("row_id", *S.positions(S.left_flank("sequence", "start", 5), "peptide", S.right_flank("sequence", "stop", 5), 5))


@query(f"""WITH {WIN}, h AS (SELECT row_id, strpos(sequence, context) AS w, strpos(sequence, peptide) AS p,
  (length(sequence) - length(replace(sequence, peptide, ''))) / 9 AS np FROM win)
SELECT row_id, CASE WHEN w > 0 THEN 'window' WHEN np = 1 THEN 'peptide' WHEN p > 0 THEN 'peptide_positional' ELSE 'none' END AS kind,
  CASE WHEN w > 0 THEN w + 5 WHEN p > 0 THEN p END::INT AS at FROM h""")
def p14_locate(spark, sf):
    w = windows(spark, sf)
    by_window, by_peptide = S.find_first("sequence", "context"), S.find_first("sequence", "peptide")
    once = F.length("sequence") - F.length(F.replace("sequence", F.col("peptide"), F.lit(""))) == 9
    kind = F.when(by_window.isNotNull(), "window").when(once, "peptide").when(by_peptide.isNotNull(), "peptide_positional").otherwise("none")
    return w.select("row_id", kind.alias("kind"), F.coalesce(by_window + 5, by_peptide).alias("at"))


@query(f"""WITH {OBS} SELECT row_id, array_to_string(list_transform(range(0, 19), lambda i: CASE WHEN start - 6 + i < 0 OR start - 6 + i >= len THEN '1' ELSE '0' END), '') AS mask,
  least(5, 5 - least(5, start - 1))::INT AS n_pad, (5 - least(5, len - stop))::INT AS c_pad FROM obs""")
def p15_p26_t09_padding(spark, sf):
    mask = S.pad_mask("start", "len", 5, 19)
    pads = tensors.pad_counts(mask, 5)
    return observations(spark, sf).select("row_id", F.array_join(F.transform(mask, lambda m: m.cast("int").cast("string")), "").alias("mask"), pads["n_pad"].alias("n_pad"), pads["c_pad"].alias("c_pad"))


_P16 = """WITH r AS (SELECT l_orderkey AS k, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem GROUP BY 1),
s AS (SELECT k, r, len(r) AS n, (k % len(r) + 1)::INT AS start FROM r), w AS (SELECT *, list_transform(range(0, 5), lambda j: start - 2 + j) AS idx FROM s)"""


@query(_P16 + """ SELECT k, round(list_sum(list_transform(idx, lambda i: CASE WHEN i BETWEEN 1 AND n THEN r[i] ELSE 0 END)), 6) AS zero,
 round(list_sum(list_transform(idx, lambda i: r[greatest(1, least(i, n))])), 6) AS boundary,
 round(list_sum(list_transform(idx, lambda i: CASE WHEN i BETWEEN 1 AND n THEN r[i] WHEN i < 1 THEN 7 ELSE 11 END)), 6) AS bos_eos,
 round(list_sum(list_transform(idx, lambda i: CASE WHEN i BETWEEN 1 AND n THEN r[i] ELSE 3 END)), 6) AS token FROM w""")
def p16_t12_window_fills(spark, sf):
    each = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")))
    o = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(each, lambda x: x["l_quantity"]).alias("r"))
    o = o.withColumn("start", (F.col("k") % F.size("r") + 1).cast("int"))
    args = {"zero": {}, "impute_boundary": {}, "impute_bos_eos": {"bos": F.lit(7.0), "eos": F.lit(11.0)}, "pad_token": {"pad": F.lit(3.0)}}
    names = {"zero": "zero", "impute_boundary": "boundary", "impute_bos_eos": "bos_eos", "pad_token": "token"}
    return o.select("k", *[F.round(F.aggregate(tensors.build_window("r", "start", 2, 5, k, **v), F.lit(0.0), lambda a, x: a + x), 6).alias(names[k]) for k, v in args.items()])


@query(f"""WITH {OBS}, w AS (SELECT row_id, lpad(substr(sequence, greatest(1, start - 10), start - greatest(1, start - 10)), 10, 'X') AS n, peptide, rpad(substr(sequence, stop + 1, greatest(0, least(10, len - stop))), 10, 'X') AS c, start, len, stop FROM obs)
SELECT row_id, substr(n, 6, 5) AS n_flank, substr(c, 1, 5) AS c_flank, substr(n || peptide || c, 6, 19) AS context, (5 - least(5, start - 1))::INT AS n_pad, (5 - least(5, len - stop))::INT AS c_pad FROM w""")
def p17_shorten(spark, sf):
    return R.shorten_windows(R.add_flanks(observations(spark, sf), 10)).select("row_id", "n_flank", "c_flank", "context", "n_pad", "c_pad")


@query(f"WITH {WIN} SELECT row_id, " + ", ".join(f"(substr(peptide, 2, 1) = '{a}')::INT AS P2_{a}" for a in S.ALPHABET) + " FROM win")
def p18_one_hot(spark, sf):
    hot = S.one_hot(F.substring("peptide", 2, 1))
    return observations(spark, sf).select("row_id", *[F.element_at(hot, i + 1).alias(f"P2_{a}") for i, a in enumerate(S.ALPHABET)])


@query(f"WITH {WIN} SELECT row_id, " + ", ".join("CASE substr(peptide, 9, 1) " + " ".join(f"WHEN '{k}' THEN {v[f]}" for k, v in S.ATCHLEY.items()) + f" ELSE 0.0 END::DOUBLE AS P9_AF{f + 1}" for f in range(5)) + " FROM win")
def p19_p21_matrix_encoding(spark, sf):
    row = S.encode(F.substring("peptide", 9, 1), S.ATCHLEY)
    return observations(spark, sf).select("row_id", *[F.element_at(row, f + 1).alias(f"P9_AF{f + 1}") for f in range(5)])


_TABLES = {"sparse": S.one_hot_table(), "kidera": S.KIDERA, "atchley": S.ATCHLEY}
_VALUES = ", ".join(f"('{e}', '{s}', [{', '.join(map(str, v))}]::DOUBLE[])" for e, t in _TABLES.items() for s, v in t.items())
_WIDTHS = ", ".join(f"('{e}', {len(t['A'])})" for e, t in _TABLES.items())


@query(f"""WITH {WIN}, v(encoding, aa, vec) AS (VALUES {_VALUES}), widths(encoding, width) AS (VALUES {_WIDTHS}), p AS (SELECT row_id, context, unnest(range(1, 20)) AS i FROM win),
s AS (SELECT p.row_id, w.encoding, w.width, p.i, v.vec FROM p CROSS JOIN widths w LEFT JOIN v ON v.encoding = w.encoding AND v.aa = substr(p.context, p.i, 1))
SELECT row_id, encoding, sum(width)::INT AS features, sum(coalesce(len(list_filter(vec, lambda x: x <> 0)), 0))::INT AS filled,
  round(sum(coalesce(list_sum(list_transform(vec, lambda x, k: x * ((i - 1) * width + k))), 0)), 4) AS weighted FROM s GROUP BY 1, 2""")
def p21_all_positions(spark, sf):
    """Every position of the window in each encoding; an array of all features per row, digested."""
    w = windows(spark, sf).select("row_id", F.split("context", "").alias("symbols"))
    each = F.explode(F.create_map(*[x for name, t in _TABLES.items() for x in (F.lit(name), S.encode_all("symbols", t))])).alias("encoding", "v")
    weighted = F.aggregate(F.transform("v", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return w.select("row_id", each).select("row_id", "encoding", F.size("v").alias("features"), F.size(F.filter("v", lambda x: x != 0)).alias("filled"), F.round(weighted, 4).alias("weighted"))


@query(f"WITH {WIN} SELECT row_id, " + ", ".join(f"round((length(context) - length(replace(context, '{a}', ''))) / 19.0::DOUBLE, 9) AS frac_{a}" for a in S.ALPHABET) + " FROM win")
def p20_composition(spark, sf):
    return windows(spark, sf).select("row_id", *[F.round(S.fraction("context", a, 19), 9).alias(f"frac_{a}") for a in S.ALPHABET])


@query(f"""WITH {OBS} SELECT row_id, (length(regexp_replace(peptide, '[^KR]', '', 'g')) - length(regexp_replace(peptide, '[^DE]', '', 'g')))::INT AS charge,
  round(length(regexp_replace(peptide, '[^AILMFVWY]', '', 'g')) / 9.0::DOUBLE, 9) AS hydrophobic FROM obs""")
def p22_m14_properties(spark, sf):
    return observations(spark, sf).select("row_id", S.net_charge("peptide").alias("charge"), F.round(S.hydrophobic_share("peptide"), 9).alias("hydrophobic"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'P' || o_orderkey END, c_name) AS acc FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def p24_coalesced_lookup(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'P' || o_orderkey END"), "c_name").alias("acc"))


@query(f"WITH {PROT}, bad AS (SELECT doc_id FROM prot WHERE contains(sequence, 'UUU') OR contains(sequence, 'Z')) SELECT doc_id, len FROM prot WHERE doc_id NOT IN (SELECT doc_id FROM bad)")
def p25_exclude_symbol(spark, sf):
    p = proteins(spark, sf)
    bad = p.where(F.col("sequence").contains("UUU") | F.col("sequence").contains("Z")).select("doc_id")
    return p.join(bad, "doc_id", "left_anti").select("doc_id", "len")


@query()
def p28_p29_random_windows(spark, sf):
    return random_windows(spark, 500, 9, anchors={1: ["L", "M"], 8: ["V", "L"]}, exclude=observations(spark, sf).select("peptide"))


@query(f"WITH {OBS} SELECT row_id, peptide FROM obs ORDER BY md5('7:' || row_id) LIMIT 50")
def p30_hash_sample(spark, sf):
    return hash_sample(observations(spark, sf), 50, "row_id", seed="7").select("row_id", "peptide")


_ITEMS = "items AS (SELECT item_id, sequence, length(sequence)::INT AS len FROM (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM benchmark))"


def items(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence")).withColumn("len", F.length("sequence"))


@query(f"""WITH {PROT}, s AS (SELECT doc_id, sequence, len, unnest(range(1, len + 1)) AS start FROM prot), k AS (SELECT *, unnest(range(8, 15)) AS n FROM s), m AS (SELECT doc_id, n, start, substr(sequence, start, n) AS kmer FROM k WHERE start + n - 1 <= len)
SELECT doc_id, n::INT AS n, count(*) AS kmers, count(DISTINCT kmer) AS kinds, min(kmer) AS first_kmer, max(kmer) AS last_kmer, max(start)::INT AS last_start FROM m GROUP BY 1, 2""")
def p31_kmers(spark, sf):
    """All k-mers of all proteins, counted by protein and length."""
    k = R.kmers(proteins(spark, sf).select("doc_id", "sequence"), "sequence")
    each = k.groupBy("doc_id", "n", "kmer").agg(F.count("*").alias("c"), F.max("start").alias("s"))
    return each.groupBy("doc_id", "n").agg(F.sum("c").alias("kmers"), F.count("*").alias("kinds"), F.min("kmer").alias("first_kmer"), F.max("kmer").alias("last_kmer"), F.max("s").alias("last_start"))


@query(f"WITH {PROT} SELECT doc_id, start::INT AS start, length(substr(sequence, start + 1, 1000))::INT AS size FROM (SELECT *, unnest(range(0, len, 900)) AS start FROM prot)")
def p32_chunks(spark, sf):
    return proteins(spark, sf).select("doc_id", "sequence", F.explode(S.chunks("len")).alias("start")).select("doc_id", "start", F.length(F.expr("substring(sequence, start + 1, 1000)")).alias("size"))


@query(f"""WITH {PROT}, c AS (SELECT doc_id, len, unnest(range(0, len, 900)) AS start FROM prot),
p AS (SELECT doc_id, pos, ((pos * 31 + start) % 997) AS v FROM (SELECT doc_id, start, unnest(range(start, least(start + 1000, len))) AS pos FROM c)),
b AS (SELECT doc_id, pos, max(v) AS best, count(*) AS coverage FROM p GROUP BY 1, 2)
SELECT doc_id, count(*) AS places, sum(best)::BIGINT AS total, sum(coverage)::BIGINT AS covered, max(coverage)::BIGINT AS most FROM b GROUP BY 1""")
def p33_s15_stitch(spark, sf):
    """Scores of chunks of 1000 symbols every 900, stitched by place; summed by protein."""
    c = proteins(spark, sf).select("doc_id", "len", F.explode(S.chunks("len", 1000, 900)).alias("start"))
    p = c.select("doc_id", "start", F.explode(F.expr("sequence(start, least(start + 1000, len) - 1)")).alias("pos"))
    each = p.withColumn("v", (F.col("pos") * 31 + F.col("start")) % 997).groupBy("doc_id", "pos").agg(F.max("v").alias("best"), F.count("*").alias("coverage"))
    return each.groupBy("doc_id").agg(F.count("*").alias("places"), F.sum("best").alias("total"), F.sum("coverage").alias("covered"), F.max("coverage").alias("most"))


@query(f"""WITH {OBS}, pos AS (SELECT row_id, start, stop, unnest(range(start, stop + 1)) AS p FROM obs),
m AS (SELECT row_id, p, CASE WHEN p % 50 = 49 THEN NULL ELSE p - p // 50 END AS q FROM pos)
SELECT row_id, CASE WHEN count(q) = count(*) AND max(q) - min(q) + 1 = count(*) THEN min(q) END::INT AS new_start, CASE WHEN count(q) = count(*) AND max(q) - min(q) + 1 = count(*) THEN max(q) END::INT AS new_stop FROM m GROUP BY row_id""")
def p34_translate(spark, sf):
    pos = observations(spark, sf).select("row_id", F.explode(F.sequence("start", "stop")).alias("p"))
    mapped = pos.select(F.col("p").cast("long").alias("id")).distinct().select(F.col("id").cast("int").alias("p"), F.expr("CASE WHEN id % 50 = 49 THEN NULL ELSE cast(id - id div 50 as int) END").alias("q"))
    g = pos.join(mapped, "p", "left").groupBy("row_id").agg(F.count("q").alias("n"), F.count("*").alias("m"), F.min("q").alias("lo"), F.max("q").alias("hi"))
    ok = (F.col("n") == F.col("m")) & (F.col("hi") - F.col("lo") + 1 == F.col("m"))
    return g.select("row_id", F.when(ok, F.col("lo")).alias("new_start"), F.when(ok, F.col("hi")).alias("new_stop"))


@query()
def p35_alignment(spark, sf):
    from strandline.operators.alignment import align

    p = items(spark, sf).select("item_id", F.col("sequence").alias("a"), F.regexp_replace("sequence", "(.{9}).", "$1").alias("b"))
    return align(p, "a", "b")


@query(f"""WITH {WIN}, c AS (SELECT row_id, context, unnest(range(1, 20)) AS i FROM win), d AS (SELECT row_id, i, substr(context, i, 1) AS s FROM c),
g AS (SELECT row_id, s, i - row_number() OVER (PARTITION BY row_id, s ORDER BY i) AS k, i FROM d)
SELECT row_id, s AS value, min(i)::INT AS first, max(i)::INT AS last, count(*)::INT AS length FROM g GROUP BY row_id, s, k HAVING count(*) > 1""")
def w09_runs(spark, sf):
    r = windows(spark, sf).select("row_id", F.explode(structure.run_table("context")).alias("r")).select("row_id", "r.value", F.col("r.first").alias("first"), F.col("r.last").alias("last"), F.col("r.length").alias("length"))
    return r.where(F.col("length") > 1)


@query("""SELECT tag, CASE WHEN contains(tag, 'T') THEN strptime(tag, '%Y-%m-%dT%H:%M:%S') ELSE strptime(tag, '%Y%m%d_%H%M%S') END AS at FROM
(SELECT CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y%m%d_%H%M%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS tag FROM events)""")
def s14_run_times(spark, sf):
    e = table(spark, sf, "events").select(F.expr("CASE WHEN event_id % 2 = 0 THEN date_format(ts, 'yyyyMMdd_HHmmss') ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") END").alias("tag"))
    return e.select("tag", T.run_time("tag").cast("timestamp_ntz").alias("at"))
