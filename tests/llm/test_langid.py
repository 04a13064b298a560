import random
import zlib

import numpy as np
import pyarrow as pa

from strandline.llm import langid


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in langid.new_model(3, hidden=4).items()}
    x, y = rng.integers(97, 103, (5, 6)).astype(np.uint8), rng.integers(0, 3, 6)
    # float32 states limit the precision
    _, grad = langid.gradients(model, x, y)
    for name in ("hf", "cb", "out", "bias", "xf"):
        at = np.unravel_index(np.argmax(np.abs(grad[name])), grad[name].shape)
        eps, keep = 1e-2, model[name][at]
        model[name][at] = keep + eps
        up, _ = langid.gradients(model, x, y)
        model[name][at] = keep - eps
        down, _ = langid.gradients(model, x, y)
        model[name][at] = keep
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 0.02 * abs(grad[name][at]) + 1e-3


def corpus(n=240):
    rng = random.Random(4)
    parts = {"xx": "ka to mi ra su neko".split(), "yy": "sch ung heit ver ein".split(), "zz": "tion eux que aux ment".split()}
    rows = []
    for i in range(n):
        lang = "xyz"[i % 3] * 2
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang, "s"))
    return rows


def test_held_out_accuracy(docs):
    rows = corpus()
    out = {r.doc_id: r for r in langid.identify(docs(rows)).collect()}
    assert len(out) == len(rows)
    own = [(out[i].lang_pred == lang) for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(own) / len(own) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in out.items())


def test_prediction_sees_the_text_only(docs):
    rows = corpus()
    languages, model = langid.fit(docs(rows), steps=60)
    a = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.predict(docs(rows), languages, model).collect()}
    hidden = [(i, t, None, None) for i, t, *_ in rows]
    b = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.predict(docs(hidden), languages, model).collect()}
    assert a == b


def test_odd_rows(docs, odd_rows):
    got = langid.identify(docs(odd_rows + [(i + 1000, *r) for i, *r in corpus(60)] + [(900, "12 34 !!", "xx", "s")])).collect()
    by = {r.doc_id: r for r in got}
    assert by[3].lang_pred == by[4].lang_pred == by[7].lang_pred == by[900].lang_pred == "und"
    assert by[8].lang_pred != "und"
    assert langid.identify(docs([])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs([(1, "abc", None, "s")])).collect()} == {"und"}


def test_remembering_changes_nothing():
    model = langid.new_model(3)
    column = pa.array([t for _, t, *_ in corpus(40)] + ["", "a" * 100])
    assert np.allclose(langid.Scorer(model, 10).score(column), langid.Scorer(model).score(column), atol=1e-6)


def test_many_languages_and_long_texts_only(docs):
    """No language is left out, however many there are and however long its texts."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdef", k=5)), f"l{i % 90:02d}", "s") for i in range(900)]
    rows += [(5000 + i, "qwx zyq " * 30_000, "long", "s") for i in range(6)]
    languages, model = langid.fit(docs(rows), steps=5)
    assert len(languages) == 91 and model["out"].shape[1] == 91


def test_learns_a_language_of_long_texts(docs):
    rows = corpus(120) + [(5000 + i, "qwx zyq " * 30_000, "long", "s") for i in range(10)]
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs(rows)).collect()}
    assert all(out[5000 + i] == "long" for i in range(10))
