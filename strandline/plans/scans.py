"""Source and sink queries. Texts in the sources' formats are made from the driver's tables, written
to the shared folder and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.plans.base import OBS, PROT, observations, proteins, table
from strandline.plans.registry import query
from strandline.sources import readers, writers
from strandline.storage import new_path


@query("SELECT c_custkey::INT AS cust_key, nullif(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END, '') AS market_segment FROM customer")
def s01_s02_s08_k01_csv(spark, sf):
    from pyspark.sql import types as T

    path = new_path(spark, "csv")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("Cust.Key"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END").alias("Market Segment"), F.lit(None).cast("string").alias("Empty-Column"))
    writers.write_table(c, path, "csv")
    schema = T.StructType([T.StructField("Cust.Key", T.IntegerType()), T.StructField("Market Segment", T.StringType()), T.StructField("Empty-Column", T.StringType())])
    return readers.drop_empty_columns(readers.read_csv(spark, path, schema))


@query(f"WITH {PROT} SELECT 'sp|P' || doc_id || '|' || source AS header, sequence FROM prot")
def s03_k03_fasta(spark, sf):
    path = new_path(spark, "fasta")
    p = proteins(spark, sf).select(F.concat(F.lit("sp|P"), F.col("doc_id"), F.lit("|"), F.col("source")).alias("header"), "sequence")
    writers.fasta_batches(p, path, size=100)
    return readers.read_fasta(spark, path).select("header", "sequence")


@query(f"WITH {OBS} SELECT doc_id, start AS Pos, peptide AS Peptide, round(rank, 3) AS Rank FROM obs WHERE rank < 0.5")
def s04_s05_binder_scan(spark, sf):
    path = new_path(spark, "binders")
    line = F.concat_ws("\t", "start", "peptide", F.concat(F.lit("sp_"), F.col("doc_id"), F.lit("_X")), "peptide", "peptide", F.lit("0.1"), F.format_string("%.3f", "rank"), F.lit("0.2"), (F.col("rank") < 0.5).cast("int"))
    observations(spark, sf).select(line.alias("value")).write.text(path)
    b = readers.read_binders(spark, path, length=9)
    return b.select(F.split_part("ID", F.lit("_"), F.lit(2)).cast("long").alias("doc_id"), "Pos", "Peptide", "Rank")


@query(f"WITH {OBS} SELECT count(*) AS n FROM obs WHERE doc_id % 3 = 0")
def s05_binder_count(spark, sf):
    path = new_path(spark, "binders")
    line = F.concat_ws("\t", "start", "peptide", F.concat(F.lit("sp_"), F.col("doc_id"), F.lit("_X")), "peptide", "peptide", F.lit("0.1"), F.format_string("%.3f", "rank"), F.lit("0.2"), (F.col("rank") < 0.5).cast("int"))
    o = observations(spark, sf)
    o.select(line.alias("value")).write.text(path)
    wanted = table(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("uniprot_id"))
    return readers.count_binders(spark, path, length=9, ids=wanted)


@query("SELECT 'af_' || n_nationkey AS af_id, n_regionkey::INT AS chunk_idx, 2::INT AS places, round(n_nationkey + 0.5 + n_regionkey, 3)::DOUBLE AS total FROM nation")
def s15_chunk_scores(spark, sf):
    """Score files named by protein and chunk; those of a lower rank are no part of the result."""
    path = new_path(spark, "scores")
    n = table(spark, sf, "nation").withColumn("rank", F.explode(F.array(F.lit("001"), F.lit("002"))))
    name = F.concat(F.lit("af_"), F.col("n_nationkey"), F.lit("_chunk_"), F.col("n_regionkey"), F.lit("_scores_rank_"), F.col("rank"), F.lit("_x.json"))
    n.select(name.alias("name"), F.array(F.col("n_nationkey") + F.lit(0.5), F.col("n_regionkey").cast("double")).alias("plddt")).write.partitionBy("name").json(path)
    got = readers.read_chunk_scores(spark, path)
    return got.select("af_id", "chunk_idx", F.size("plddt").alias("places"), F.round(F.element_at("plddt", 1) + F.element_at("plddt", 2), 3).alias("total"))


@query(f"WITH {OBS} SELECT row_id % 1000 AS pos, peptide, 'sp_P' || doc_id || '_S' AS identity, round(rank, 3) AS n1, 0.25::DOUBLE AS n2, CASE WHEN rank < 0.5 THEN 'SB' END AS level FROM obs")
def s06_ragged_report(spark, sf):
    line = F.concat(F.lit("  "), (F.col("row_id") % 1000).cast("string"), F.lit("  HLA-A*02:01  "), F.col("peptide"), F.lit("   sp|P"), F.col("doc_id"), F.lit("|S  "), F.format_string("%.3f", "rank"), F.lit("  0.25"), F.when(F.col("rank") < 0.5, " <= SB").otherwise(""))
    noise = spark.createDataFrame([("# header",), ("",), (" Pos  HLA  Peptide",), ("-----",)], "value string")
    got = readers.parse_report(observations(spark, sf).select(line.alias("value")).union(noise))
    return got.select(F.col("pos").cast("long").alias("pos"), "peptide", "identity", "n1", "n2", "level")


@query("SELECT replace(p_brand, '#', '') AS p_brand, count(*) AS n FROM part GROUP BY 1")
def s07_path_key(spark, sf):
    """A key from the folder's name, as in a tree of one folder a key."""
    path = new_path(spark, "tree")
    p = table(spark, sf, "part").select(F.concat(F.lit("7_"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("folder"), F.col("p_partkey").cast("string").alias("value"))
    p.repartition("folder").write.partitionBy("folder").text(path)
    got = readers.with_path_key(spark.read.text(path), r"/folder=[0-9]+_([^/]+)/[^/]+$", "p_brand")
    return got.groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT (o_orderkey % 9999)::INT AS residue_num, 'ALA' AS aa, round((o_custkey % 100) + 0.5, 2)::DOUBLE AS plddt FROM orders WHERE o_orderkey % 2 = 0")
def s09_fixed_width(spark, sf):
    o = table(spark, sf, "orders")
    atom = F.when(F.col("o_orderkey") % 2 == 0, F.lit(" CA ")).otherwise(F.lit(" N  "))
    line = F.concat(F.lit("ATOM  "), F.lpad((F.col("o_orderkey") % 99999).cast("string"), 5, " "), F.lit(" "), atom, F.lit(" ALA A"), F.lpad((F.col("o_orderkey") % 9999).cast("string"), 4, " "), F.lpad(F.lit(""), 34, " "), F.lpad(F.format_string("%.2f", (F.col("o_custkey") % 100) + F.lit(0.5)), 6, " "))
    return readers.parse_atoms(o.select(line.alias("value"))).select("residue_num", "aa", "plddt")


@query(f"WITH {OBS}, need AS (SELECT doc_id FROM prot WHERE source IN ('src1', 'src2', 'src3') UNION SELECT -7), have AS (SELECT DISTINCT doc_id FROM obs) SELECT n.doc_id, (SELECT count(*) FROM obs o WHERE o.doc_id = n.doc_id) AS rows FROM need n")
def s10_lookup(spark, sf):
    need = proteins(spark, sf).where("source IN ('src1', 'src2', 'src3')").select("doc_id").union(spark.range(1).select(F.lit(-7).cast("long")))
    found, missing = readers.lookup(observations(spark, sf).select("doc_id", "row_id"), need, "doc_id")
    return found.groupBy("doc_id").agg(F.count("*").alias("rows")).union(missing.select("doc_id", F.lit(0).cast("long")))


@query("SELECT o_orderkey AS id, 'A' AS chain, 'AGXWU' || 'KL' AS sequence FROM orders")
def s11_seqres(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    two = F.array(F.lit("SEQRES   2 A    7  LYS LEU"), F.lit("SEQRES   1 A    7  ALA GLY ZZZ TRP SEC"), F.lit("REMARK"))
    return readers.parse_seqres(o.select("id", F.explode(two).alias("value")), "id")


@query("SELECT event_id, coalesce((props::JSON->>'k')::INT, -1) AS k FROM events")
def s14_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.from_json("props", "k int")["k"], F.lit(-1)).alias("k"))


@query(f"WITH {OBS} SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM obs GROUP BY 1")
def k02_distinct_list(spark, sf):
    o = observations(spark, sf).select("lang", "source").distinct()
    return o.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"))


@query(f"WITH {OBS}, a AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'P' || (10000 + doc_id) || '-1' WHEN doc_id % 3 = 1 THEN 'Q' || (10000 + doc_id) ELSE 'bad id' END AS acc FROM obs) SELECT CASE WHEN doc_id % 3 = 0 THEN 'isoform' WHEN doc_id % 3 = 1 THEN 'canonical' ELSE 'invalid' END AS kind, acc, min(start) AS lo, max(stop) AS hi, count(*) AS n FROM a GROUP BY 1, 2")
def k08_routed_lists(spark, sf):
    acc = F.expr("CASE WHEN doc_id % 3 = 0 THEN 'P' || (10000 + doc_id) || '-1' WHEN doc_id % 3 = 1 THEN 'Q' || (10000 + doc_id) ELSE 'bad id' END")
    return writers.routed(observations(spark, sf).withColumn("acc", acc))
