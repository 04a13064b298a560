"""Readers of the text formats: delimited, FASTA, binder reports, fixed-width structures, runs.

All parse with column functions on ``spark.read.text``, so they split, push down and
recover like any scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.text import clean_name, run_time

# fixed values: three-letter residue names
THREE = {
    "ALA": "A", "CYS": "C", "ASP": "D", "GLU": "E", "PHE": "F", "GLY": "G", "HIS": "H", "ILE": "I", "LYS": "K", "LEU": "L", "MET": "M",
    "ASN": "N", "PRO": "P", "GLN": "Q", "ARG": "R", "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y", "SEC": "U", "PYL": "O", "UNK": "X",
}
BINDER = T.StructType([T.StructField("Pos", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("Peptide", "ID", "core", "icore")], *[T.StructField(c, T.DoubleType()) for c in ("Score", "Rank", "Ave")], T.StructField("NB", T.IntegerType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Declared schema, empty text as null, names cleaned."""
    df = spark.read.schema(schema).option("header", header).option("emptyValue", "").csv(path)
    df = df.select([F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in schema])
    return df.toDF(*[clean_name(c) for c in df.columns])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Columns without any value go; one aggregate finds them."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c]])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Header and sequence of each record; records end at the next line that starts with >."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    head = F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), "\r", ""))
    body = F.regexp_replace(F.regexp_replace(text, "^[^\n]*(\n|$)", ""), "\\s", "")
    return raw.select(head.alias("header"), body.alias("sequence")).where("header <> '' or sequence <> ''")


def read_binders(spark: SparkSession, path: str, binders_only: bool = True, length: int | None = None) -> DataFrame:
    """Predictions of all files of a folder (tab-separated, two header lines), filtered in the scan."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    rows = rows.where((F.size("f") >= 9) & F.try_element_at("f", F.lit(1)).rlike("^[0-9]+$"))
    df = rows.select(*[F.try_element_at("f", F.lit(i + 1)).try_cast(s.dataType).alias(s.name) for i, s in enumerate(BINDER)])
    if length is not None:
        df = df.where(F.length("Peptide") == length)
    return df.where("NB = 1") if binders_only else df


def count_binders(spark: SparkSession, path: str, length: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Number of predictions of all files, binders or not, of a length and of the wanted
    accessions (second part of the identity), one column ``uniprot_id`` in ``ids``."""
    df = read_binders(spark, path, binders_only=False, length=length)
    if ids is not None:
        df = df.withColumn("uniprot_id", F.split_part("ID", F.lit("_"), F.lit(2))).join(ids.select("uniprot_id").distinct(), "uniprot_id", "left_semi")
    return df.agg(F.count("*").alias("n"))


def read_chunk_scores(spark: SparkSession, path: str) -> DataFrame:
    """af_id, chunk_idx and plddt of score files of the best rank, by the files' (or their
    folders') names; other files are left out."""
    name = r"/(?:[^/=]+=)?(af_[0-9]+)_chunk_([0-9]+)_scores_rank_001_"
    df = spark.read.schema("plddt array<double>").option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("_file"))
    keyed = df.select(F.nullif(F.regexp_extract("_file", name, 1), F.lit("")).alias("af_id"), F.regexp_extract("_file", name, 2).try_cast("int").alias("chunk_idx"), "plddt")
    return keyed.where("af_id is not null")


def parse_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """Ragged report lines: those that start with a whole number, split at white space;
    the identity is the first token with an underscore, bar or accession, five numbers follow,
    then the binding level."""
    t = lines.select(F.split(F.trim(column), "\\s+").alias("t")).where(F.try_element_at("t", F.lit(1)).rlike("^[0-9]+$"))
    at = F.array_position(F.transform("t", lambda x: x.rlike("^[A-Za-z]+[_|][A-Za-z0-9_|-]+$")), True)
    t = t.withColumn("at", at.cast("int")).where("at > 0")
    rest = F.filter(F.slice("t", F.col("at") + 1, F.size("t")), lambda x: ~x.isin("<=", "*"))
    t = t.withColumn("rest", rest)
    numbers = F.filter("rest", lambda x: x.try_cast("double").isNotNull())
    level = F.filter("rest", lambda x: x.try_cast("double").isNull())
    identity = F.replace(F.element_at("t", F.col("at")), F.lit("|"), F.lit("_"))
    return t.select(F.element_at("t", 1).cast("int").alias("pos"), F.element_at("t", 3).alias("peptide"), identity.alias("identity"), *[F.try_element_at(numbers, F.lit(i + 1)).try_cast("double").alias(f"n{i + 1}") for i in range(5)], F.nullif(F.array_join(level, " "), F.lit("")).alias("level"))


def with_path_key(df: DataFrame, pattern: str = r"/(?:[0-9]+_)?([^/]+)/[^/]+$", name: str = "uniprot") -> DataFrame:
    """A key from the file's folder, without its number."""
    return df.select("*", F.regexp_extract("_metadata.file_path", pattern, 1).alias(name))


def parse_atoms(lines: DataFrame, column: str = "value") -> DataFrame:
    """Alpha carbons of fixed-width records: residue, number, confidence."""
    v = F.col(column)
    ca = lines.where((F.substring(v, 1, 6) == "ATOM  ") & (F.substring(v, 13, 4) == " CA "))
    return ca.select(F.trim(F.substring(v, 18, 3)).alias("aa"), F.trim(F.substring(v, 23, 4)).try_cast("int").alias("residue_num"), F.trim(F.substring(v, 61, 6)).try_cast("double").alias("plddt"))


def parse_seqres(lines: DataFrame, key: str, column: str = "value") -> DataFrame:
    """One-letter sequence of each chain from its SEQRES records, in their order."""
    v = F.col(column)
    s = lines.where(F.substring(v, 1, 6) == "SEQRES").select(key, F.trim(F.substring(v, 8, 3)).cast("int").alias("n"), F.substring(v, 12, 1).alias("chain"), F.split(F.trim(F.substring(v, 20, 51)), "\\s+").alias("names"))
    letters = F.create_map(*[F.lit(x) for kv in THREE.items() for x in kv])
    g = s.groupBy(key, "chain").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", "names"))), lambda x: x["names"])).alias("names"))
    return g.select(key, "chain", F.array_join(F.transform("names", lambda x: F.coalesce(F.try_element_at(letters, x), F.lit("X"))), "").alias("sequence"))


def lookup(df: DataFrame, needed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the needed keys, and the needed keys without any."""
    ids = needed.select(key).distinct()
    return df.join(ids, key, "left_semi"), ids.join(df.select(key), key, "left_anti")


RUN = "model_key string, features_key string, run_tag string, outer_val_predictions map<string, struct<y_true: array<int>, y_prob: array<double>>>, cv_summary map<string, struct<mean: double, std: double>>"


def read_runs(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Run documents with a declared schema, from a time on."""
    df = spark.read.schema(RUN).option("multiLine", True).json(path).withColumn("at", run_time("run_tag"))
    return df.where(F.col("at") >= F.to_timestamp(F.lit(since))) if since else df


def run_scores(runs: DataFrame) -> DataFrame:
    """model, features, fold, place, y_true, y_prob."""
    each = runs.select("model_key", "features_key", F.explode("outer_val_predictions").alias("fold", "p"))
    return each.select("model_key", "features_key", F.col("fold").cast("int").alias("fold"), F.posexplode(F.arrays_zip("p.y_true", "p.y_prob")).alias("place", "z")).select("model_key", "features_key", "fold", "place", "z.y_true", "z.y_prob")
