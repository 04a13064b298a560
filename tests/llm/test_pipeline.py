import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from strandline.llm.queries import word_tokenizer
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_near_dup import brute as near


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    from strandline.llm._common import materialize

    for _, stage in P.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir), "test-stage"))
    return out


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_language_stage_keeps_all_texts_with_letters(stages):
    assert {r[0] for r in rows_of(stages[1])} == {r[0] for r in rows_of(stages[0]) if any(c.isalpha() for c in r[1] or "")}


def test_one_document_of_each_group_stays(stages):
    rows = rows_of(stages[1])
    assert {r[0] for r in rows_of(stages[2])} == {d for d, _, _, kept in near([(r[0], r[1]) for r in rows]) if kept}


def test_contaminated_documents_go(spark, sf_dir, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = rows_of(stages[2])
    assert {r[0] for r in rows_of(stages[3])} == {r[0] for r in rows} - {w[0] for w in contaminated(rows, items)}


def test_mixing_keeps_rows_and_columns(stages):
    assert sorted(rows_of(stages[4])) == sorted(rows_of(stages[3]))
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_tokens_follow_the_mixture(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    order = P.with_place(stages[4]).orderBy("_file", "_row").collect()
    got = sorted(stages[5].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in order]
    start = 0
    for r, d in zip(got, order):
        ids = tokenizer.encode(d.text, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_odd_rows_pass_all_stages(spark, sf_dir, odd_rows):
    docs = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in odd_rows], "doc_id long, text string, lang string, source string, n_chars long")
    from strandline.llm._common import materialize

    for table in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            table = materialize(stage(spark, table, sf_dir), "odd-stage")
        table.count()


def test_language_stage_judges_by_the_network(spark, sf_dir):
    import random

    rng = random.Random(5)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    foreign = ["".join(rng.choices("бвгдежзиклмнопрстуфхцчшщ    ", k=4000)), "".join(chr(rng.randint(0x4E00, 0x9FA0)) + " " * (i % 4 == 0) for i in range(3000))]
    long = [r.text for r in given.where("length(text) between 2000 and 4000").dropDuplicates(["lang"]).collect()]
    rows = [(-1 - i, t, None, "s", 0) for i, t in enumerate(foreign)] + [(-100, "\n".join(long), None, "s", 0)]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.language_id(spark, given.select(extra.columns).union(extra), sf_dir).where("doc_id < 0").collect()}
    assert len(long) > 1 and kept == {-100}


def test_rows_pass_where_no_language_is_learned(spark, sf_dir):
    rows = [(1, "some words", None, "s", 0), (2, "12 34", "en", "s", 0), (3, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert P.language_id(spark, docs, sf_dir).count() == 3
