import random
import re

import pytest

from strandline.llm.decontam import clean_documents, contaminated, needed_hits


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, items, percent=75):
    out = []
    for i, t, *_ in rows:
        s = shingles(t)
        for j, u in items:
            g = shingles(u)
            if j is not None and g and 100 * len(g & s) >= percent * len(g):
                out.append((i, j, len(g), len(g & s)))
    return out


@pytest.fixture
def bench(spark):
    return lambda items: spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def corpus():
    rng = random.Random(0)
    words = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice((2, 6, 14, 40, 90, 300))))) for i in range(40)]
    rows = []
    for i in range(200):
        w = rng.choices(words, k=rng.choice((10, 300, 6000)))
        if i % 2 == 0:
            item = items[rng.randrange(40)][1].split()
            for _ in range(rng.choice((0, 0, 1, 2, 5))):
                item[rng.randrange(len(item))] = "zzz"
            at = rng.randrange(len(w))
            w = w[:at] + item + w[at:]
        rows.append((i, " ".join(w), "en", "s"))
    return rows + [(500, items[0][1], "en", "s"), (501, items[1][1].upper(), "en", "s")], items


def test_against_brute_force(docs, bench):
    rows, items = corpus()
    want = sorted(brute(rows, items))
    assert len(want) > 60
    assert sorted(map(tuple, contaminated(docs(rows), bench(items)).collect())) == want
    assert sorted(map(tuple, contaminated(docs(rows), bench(items), block_shingles=500).collect())) == want
    left = {r.doc_id for r in clean_documents(docs(rows), bench(items), block_shingles=700).collect()}
    assert left == {r[0] for r in rows} - {w[0] for w in want}


def test_odd_rows(docs, bench, odd_rows):
    items = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "w0 w1 w2 w3 w4"), (4, "w7 w8 w9 w10 w11 w12")]
    got = sorted(map(tuple, contaminated(docs(odd_rows), bench(items)).collect()), key=str)
    assert got == sorted(brute(odd_rows, items), key=str)
    assert contaminated(docs([]), bench(items)).count() == 0
    assert contaminated(docs(odd_rows), bench([])).count() == 0
    assert clean_documents(docs(odd_rows), bench([])).count() == len(odd_rows)


def test_hits_that_are_asked_for():
    assert needed_hits(4, 75) == 3
    assert 1 <= needed_hits(500, 75) <= 0.75 * 48
