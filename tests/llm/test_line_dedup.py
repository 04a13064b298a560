import hashlib
import random
import zlib

from strandline.llm.line_dedup import remove_repeated_lines


def place(i, text):
    """Documents in order: the id, then the MD5 of the text (two texts of one id are two documents)."""
    return (-(2**63) if i is None else i), hashlib.md5((text or "").encode()).digest()


def brute(rows, window):
    first = {}
    for i, text in rows:
        d = place(i, text)
        solid = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\f\v")]
        for j in range(len(solid) - window + 1):
            key = tuple(solid[j : j + window])
            first[key] = min(first.get(key, (d, j)), (d, j))
    out = []
    for i, text in rows:
        d, lines = place(i, text), (text or "").split("\n")
        places = [k for k, x in enumerate(lines) if x.strip(" \t\n\r\f\v")]
        gone = set()
        for j in range(len(places) - window + 1):
            if first[tuple(lines[k] for k in places[j : j + window])] != (d, j):
                gone |= set(places[j : j + window])
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        runs = sum(p in gone and (n == 0 or places[n - 1] not in gone) for n, p in enumerate(places))
        out.append((i, len(places), len(gone), runs, hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_against_brute_force(docs):
    rng = random.Random(1)
    lines = [f"line {i}" for i in range(25)] + ["", "  "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 25)))) for i in range(80)]
    df = docs([(i, t, "en", "s") for i, t in rows])
    for window in (1, 2, 3, 4):
        got = {r.doc_id: tuple(r) for r in remove_repeated_lines(df, window).collect()}
        for w in brute(rows, window):
            assert got[w[0]] == w


def test_no_python_in_the_plan(spark, docs, odd_rows):
    df = remove_repeated_lines(docs(odd_rows))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapPartitions"))


def test_odd_rows(docs, odd_rows):
    rows = odd_rows + [(20, "a\nb\n\nc"), (21, "x\na\nb\nc\n"), (21, "x\na\nb\nc\n"), (22, "a\nb")]
    full = [(r[0], r[1], "en", "s") for r in rows]
    got = sorted((tuple(r) for r in remove_repeated_lines(docs(full)).collect()), key=str)
    want = sorted(brute([(r[0], r[1]) for r in rows], 2), key=str)
    assert got == want
    assert remove_repeated_lines(docs([])).count() == 0


def test_many_texts_of_one_id_and_of_none(docs):
    """Each text is a document of its own, also where 32-bit checksums are equal."""
    a, b = collision()
    rng = random.Random(2)
    lines = [f"common {i}" for i in range(30)]
    rows = [(1, a), (7, a), (7, b), (7, a), (7, ""), (7, "one")]
    rows += [(None, "\n".join([f"own {k}"] + rng.choices(lines, k=rng.randint(0, 12)) + [""])) for k in range(300)]
    rows += [(9, f"x{k}\n" + "\n".join(lines[:5])) for k in range(20)]
    got = sorted((tuple(r) for r in remove_repeated_lines(docs([(i, t, "en", "s") for i, t in rows])).collect()), key=str)
    assert got == sorted(brute(rows, 2), key=str)


def collision():
    """Two texts of two lines with one CRC-32."""
    seen = {}
    for k in range(2**18):
        t = f"{k}\nanother line of {k * 7919 % 104729}"
        c = zlib.crc32(t.encode())
        if c in seen:
            return seen[c], t
        seen[c] = t
    raise AssertionError("none found")


def test_long_document(docs):
    body = [f"line {i % 5000}" for i in range(20000)]
    rows = [(1, "\n".join(body)), (2, "\n".join(body[3000:9000])), (3, "a\n\n \nb\n" * 3)]
    got = sorted(tuple(r) for r in remove_repeated_lines(docs([(i, t, "en", "s") for i, t in rows])).collect())
    assert got == sorted(brute(rows, 2))
