import hashlib
import tempfile
import zlib

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm.suffix_dedup import collection_bwt, remove_repeats, repeated_windows


FOLDER = tempfile.mkdtemp(prefix="strandline-test-")


def place(i, t):
    """Documents in order: the id, then a hash of the text (two texts of one id are two documents)."""
    h = xxhash.xxh64_intdigest(t, 42)
    return (-(2**63) if i is None else i), h - 2**64 * (h >= 2**63)


def brute(rows, length=100):
    first = {}
    for i, text in rows:
        t = (text or "").encode()
        d = place(i, t)
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            first[w] = min(first.get(w, (d, s)), (d, s))
    out = []
    for i, text in rows:
        t = (text or "").encode()
        d = place(i, t)
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] != (d, s):
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(bool(gone[k]) and (k == 0 or not gone[k - 1]) for k in range(len(t)))
        out.append((i, len(t), int(gone[: len(t)].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@settings(deadline=None, max_examples=100)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=8))
def test_column_wise_construction(reads):
    ends = np.concatenate(([0], np.cumsum([len(r) for r in reads])))
    bwt, lcp, owner, suffix = collection_bwt(np.array([x for r in reads for x in r], np.uint8), ends, FOLDER)
    suffixes = [(reads[o][len(reads[o]) - s :], o) for o, s in zip(owner, suffix)]
    assert sorted((o, int(s)) for o, s in zip(owner, suffix)) == sorted((i, s) for i, r in enumerate(reads) for s in range(len(r) + 1))
    for (a, _), (b, _), common in zip(suffixes, suffixes[1:], lcp[1:]):
        assert a <= b
        assert common == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for (s, o), symbol in zip(suffixes, bwt):
        at = len(reads[o]) - len(s)
        assert symbol == (reads[o][at - 1] if at else 0)


def test_repeated_windows_of_reads():
    rng = np.random.default_rng(3)
    reads = [bytes(rng.integers(97, 99, rng.integers(8, 30)).astype(np.uint8)) for _ in range(40)]
    doc, start = np.arange(40) // 2, np.arange(40) % 2 * 100
    got = set(zip(*(x.tolist() for x in repeated_windows(reads, doc, start, 8, FOLDER))))
    first = {}
    for i, r in enumerate(reads):
        for o in range(len(r) - 7):
            first.setdefault(r[o : o + 8], (doc[i], start[i] + o))
            first[r[o : o + 8]] = min(first[r[o : o + 8]], (doc[i], start[i] + o))
    want = {(i, o) for i, r in enumerate(reads) for o in range(len(r) - 7) if first[r[o : o + 8]] != (doc[i], start[i] + o)}
    assert got == want


def corpus():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(2, 8))) for _ in range(60)]
    passage = " ".join(rng.choice(words, 60))
    rows = []
    for i in range(60):
        body = " ".join(rng.choice(words, rng.integers(0, 120)))
        if i % 3 == 0:
            cut = int(rng.integers(0, 80))
            body = body[:cut] + passage[cut // 2 :] + body[cut:]
        rows.append((i, body if i % 9 else "ab " * 200))
    return rows + [(60 + i, rows[i][1]) for i in range(0, 20, 2)] + [(100, "x" * 99), (101, None), (102, "")]


def test_against_brute_force(docs):
    rows = corpus()
    df = docs([(i, t, "en", "s") for i, t in rows])
    got = sorted(tuple(r) for r in remove_repeats(df).collect())
    assert got == sorted(brute(rows))
    hot = sorted(tuple(r) for r in remove_repeats(df, hot_reads=1, collection=2000).collect())
    assert hot == got


def test_odd_rows(docs, odd_rows):
    got = sorted((tuple(r) for r in remove_repeats(docs(odd_rows)).collect()), key=str)
    assert got == sorted(brute([(i, t) for i, t, *_ in odd_rows]), key=str)
    assert remove_repeats(docs([])).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in remove_repeats(docs(odd_rows), keep_text=True).collect() if r.doc_id == 5}
    assert kept[5].decode() == odd_rows[7][1]


def test_many_texts_of_one_id_and_of_none(docs):
    """Each text is a document of its own, also where short checksums are equal."""
    rng = np.random.default_rng(11)
    passage = "shared " + " ".join(str(x) for x in rng.integers(0, 10**6, 40))
    seen, pairs = {}, []
    for k in range(3000):
        t = f"{k:06d} " + " ".join(str(x) for x in rng.integers(0, 10**9, 30))
        pairs += [(seen[c], t)] if (c := zlib.crc32(t.encode()) & (2**18 - 1)) in seen else []
        seen[c] = t
    assert pairs
    a, b = pairs[0]
    rows = [(1, a[:300]), (7, a), (7, b), (7, a), (7, "short"), (7, "")]
    rows += [(None, f"{k} " + (passage if k % 3 == 0 else t)) for k, t in enumerate(list(seen.values())[:1100])]
    rows += [(9, f"x{k} " + passage) for k in range(20)]
    got = sorted((tuple(r) for r in remove_repeats(docs([(i, t, "en", "s") for i, t in rows])).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
