import random
import re

import pytest

from strandline.llm.near_dup import near_duplicates, needed_values


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = sets[i] == sets[j] and sets[i]
            near = rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
            if same or near:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = low[find(i)] if sets[i] else d
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return out


def corpus(seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.randint(1, 90)) for _ in range(25)]
    base.append(rng.choices(words, k=120))
    rows = []
    for i in range(260):
        w = list(base[-1] if i % 2 else rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 3, 4, 5))):
            at = rng.randrange(len(w))
            if rng.random() < 0.3 and len(w) > 6:
                del w[at : at + rng.randint(1, 12)]
                w = w or ["x"]
            else:
                w[at] = rng.choice(words)
        if rng.random() < 0.2:
            w = rng.choices(words, k=30) + base[0][:60]
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    return rows


def test_against_brute_force(docs):
    rows = corpus()
    df = docs([(i, t, "en", "s") for i, t in rows])
    want = sorted(brute(rows))
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == want


def test_long_lists_are_settled_exactly(docs):
    rows = corpus(5)[:160]
    df = docs([(i, t, "en", "s") for i, t in rows])
    assert sorted(tuple(r) for r in near_duplicates(df, small=2, next_small=3).collect()) == sorted(brute(rows))


def test_odd_rows(docs, odd_rows):
    got = sorted((tuple(r) for r in near_duplicates(docs(odd_rows)).collect()), key=str)
    assert got == sorted(brute([(r[0], r[1]) for r in odd_rows]), key=str)
    assert near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("percent,k", [(30, 256), (50, 128), (90, 64)])
def test_other_similarities(docs, percent, k):
    rows = corpus(9)[:120]
    df = docs([(i, t, "en", "s") for i, t in rows])
    assert sorted(tuple(r) for r in near_duplicates(df, percent=percent, k=k).collect()) == sorted(brute(rows, percent))


def test_narrow_sketches_are_refused(docs):
    assert needed_values(75) == 27
    with pytest.raises(ValueError):
        near_duplicates(docs([]), percent=10, k=16)


def test_repeated_rows_repeat_no_work(docs):
    rows = corpus(3)[:40]
    df = docs([(i, t, "en", "s") for i, t in rows] * 4)
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == sorted(brute(rows) * 4)
