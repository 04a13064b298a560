"""The operators as queries over the ``documents``, ``benchmark`` and ``embeddings`` tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.decontam import contaminated
from strandline.llm.langid import identify
from strandline.llm.line_dedup import remove_repeated_lines
from strandline.llm.mixing import mix_documents
from strandline.llm.near_dup import near_duplicates
from strandline.llm.pii import find_personal_data
from strandline.llm.sharding import shard_documents
from strandline.llm.suffix_dedup import remove_repeats
from strandline.llm.tokens import read_store, write_store
from strandline.llm.topk import top_k


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(_docs(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_docs(spark, sf_dir))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    store = write_store(docs, word_tokenizer())
    return read_store(spark, store, docs.select("doc_id"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_docs(spark, sf_dir), length=100)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_lines(_docs(spark, sf_dir), window=2)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir), percent=75)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_docs(spark, sf_dir))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, modulus=50)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_docs(spark, sf_dir))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_mixing, op3_tokens, op4_suffix_dedup, op5_line_dedup, op6_minhash, op7_pii, op8_topk, op9_langid, op10_decontam, pipeline)
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = """CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')))
     WHEN len(w) > 0 THEN ['short: ' || list_aggregate(w, 'string_agg', ' ')] ELSE [] END"""

_CRC = """tab(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8)"""

ORACLES: dict[str, str] = {
    "op1_sharding": f"""
WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5('shards:' || coalesce(doc_id::VARCHAR, '')) AS h, source IS NULL AS none, coalesce(source, '') AS name,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table),
r AS (SELECT *, row_number() OVER (PARTITION BY none, name ORDER BY h, doc_id NULLS FIRST, text_crc32) AS rank, count(*) OVER (PARTITION BY none, name) AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank - 1)::DOUBLE / (2 * n)::DOUBLE, none, name, h, doc_id NULLS FIRST, text_crc32) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (pos * 8 // total)::INT AS shard, (pos - ((pos * 8 // total) * total + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard FROM p""",
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, k, x, regexp_matches(x, '[^\s]') AS solid
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)),
numbered AS (SELECT doc_id, k, x, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM lines WHERE solid),
pairs AS (SELECT a.doc_id, a.n, a.x AS x, b.x AS y FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND b.n = a.n + 1),
ranked AS (SELECT doc_id, n, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, n) AS r FROM pairs),
starts AS (SELECT doc_id, n FROM ranked WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, n FROM (SELECT doc_id, n FROM starts UNION ALL SELECT doc_id, n + 1 FROM starts)),
runs AS (SELECT doc_id, count(*) AS n_runs FROM (SELECT doc_id, n, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM starts) WHERE p IS NULL OR n > p + 2 GROUP BY 1),
kept AS (
  SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.k) FILTER (WHERE g.n IS NULL) AS kept, count(*) FILTER (WHERE l.solid) AS n_lines, count(g.n) AS n_removed
  FROM lines l LEFT JOIN numbered m ON m.doc_id = l.doc_id AND m.k = l.k LEFT JOIN gone g ON g.doc_id = m.doc_id AND g.n = m.n GROUP BY 1)
SELECT k.doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM kept k LEFT JOIN runs r ON r.doc_id = k.doc_id""",
    "op6_minhash": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, {_SHINGLES} AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.r)
SELECT s.doc_id, s.n AS n_shingles, min(r.r) AS component_id, s.doc_id = min(r.r) AS kept FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n""",
    "op8_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5""",
    "op10_decontam": f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
d AS (SELECT doc_id, unnest({_SHINGLES}) AS g FROM dw),
i AS (SELECT item_id, {_SHINGLES} AS s FROM iw),
e AS (SELECT item_id, len(s)::BIGINT AS n_item, unnest(s) AS g FROM i)
SELECT doc_id, item_id, n_item, count(*)::BIGINT AS n_shared FROM d JOIN e ON d.g = e.g GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item""",
    "op4_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (SELECT doc_id, b, substr(x, 2 * b + 1, 2 * (500 + 99)) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99, 500)) AS b FROM h WHERE length(x) >= 200)),
places AS (SELECT doc_id, b, y, unnest(range(0, length(y) // 2 - 99)) AS o FROM blocks),
win AS (SELECT doc_id, b + o AS s, row_number() OVER (PARTITION BY substr(y, 2 * o + 1, 200) ORDER BY doc_id, b + o) AS r FROM places),
later AS (SELECT doc_id, s, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS isl, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM win WHERE r > 1),
marked AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM later),
spans AS (SELECT doc_id, g, min(s) AS a, max(s) + 100 AS b FROM marked GROUP BY 1, 2),
edge AS (SELECT doc_id, b AS from_, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS to_, a FROM spans),
rest AS (SELECT e.doc_id, string_agg(substr(x, 2 * from_ + 1, 2 * (coalesce(to_, length(x) // 2) - from_)), '' ORDER BY a) AS tail, min(a) AS first_a, sum(coalesce(to_, length(x) // 2) - from_) AS n_tail, count(*) AS n_spans FROM edge e JOIN h ON h.doc_id = e.doc_id GROUP BY 1)
SELECT h.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(length(x) // 2 - first_a - n_tail, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN r.doc_id IS NULL THEN x ELSE substr(x, 1, 2 * first_a) || coalesce(tail, '') END)) AS kept_sha256
FROM h LEFT JOIN rest r ON r.doc_id = h.doc_id""",
}
