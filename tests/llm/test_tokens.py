import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm.queries import word_tokenizer
from strandline.llm.tokens import IndexPart, TokenStore, WordEncoder, build_part, read_store, write_store


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(word_tokenizer(), remember=3000)


ODD = ["", " ", "It's they'll can'T 's.", "<|endoftext|> <|ENDOFTEXT|>. a<|endoftext|>!", "abc).", "a...b!!", "Café. É. İ ΣΑΣ.", "12.34, 5.", "日本語。テスト.", "\x00a\x01", "🙂🙂. ok🙂?", "ﬁ. ǅ! ß?", "x" * 3000]


def test_encoding_equals_the_library(encoder):
    ids, bounds = encoder.encode(pa.array(ODD))
    for i, text in enumerate(ODD):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_any_text(encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, bounds = encoder.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_index_is_minimal_and_perfect():
    rng = np.random.default_rng(0)
    doc, occ = rng.integers(-(2**62), 2**62, 5000), rng.integers(-3, 4, 5000)
    part = IndexPart(build_part(doc, occ, np.arange(5000) % 7, np.arange(5000) * 3, np.arange(5000) % 100))
    at = part.find(doc, occ)
    assert sorted(at.tolist()) == list(range(5000))
    assert (part.entries["offset"][at] == np.arange(5000) * 3).all()
    assert (part.find(doc + 1, occ) >= 0).sum() <= 1


def test_round_trip(spark, docs, odd_rows, encoder):
    rows = odd_rows + [(100 + i, f"Word{i} and {t}", "en", "z") for i, t in enumerate(ODD)]
    df = docs(rows)
    path = write_store(df, word_tokenizer())
    got = sorted(read_store(spark, path, df.select("doc_id")).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in ordered]
    start, store = 0, TokenStore(path)
    want = {}
    for i, text, *_ in rows:
        want.setdefault(i, []).append(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    for r in got:
        assert r.start == start
        start += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want[r.doc_id]]
    for i, lists in want.items():
        assert sorted(store.get(i, k).tolist() for k in range(len(lists))) == sorted(lists)
    assert store.get(999_999) is None
    empty = write_store(docs([]), word_tokenizer())
    assert read_store(spark, empty, df.select("doc_id")).count() == 0 and TokenStore(empty).get(1) is None
