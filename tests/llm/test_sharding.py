from collections import Counter, defaultdict
from math import floor

from strandline.llm.sharding import shard_documents


def test_shards_hold_the_mixture(docs):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    out = shard_documents(docs(rows), shards=7).collect()
    assert sorted(r.position for r in out) == list(range(600))
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    total = Counter(s for *_, s in rows)
    held = defaultdict(Counter)
    for r in out:
        held[r.shard][r.source] += 1
    for shard in held:
        for source, n in total.items():
            assert abs(held[shard][source] - n / 7) <= 1 + len(total) * n / 600
    for shard in range(7):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sizes[shard]))


def test_order_is_by_fractional_rank(docs):
    rows = [(i, "x", "en", "ab"[i % 4 == 0]) for i in range(80)]
    out = sorted(shard_documents(docs(rows), shards=4).collect(), key=lambda r: r.position)
    seen = Counter()
    fractions = []
    total = Counter(r.source for r in out)
    for r in out:
        seen[r.source] += 1
        fractions.append((2 * seen[r.source] - 1) / (2 * total[r.source]))
    assert fractions == sorted(fractions)
    assert [r.shard for r in out] == [floor(i * 4 / 80) for i in range(80)]


def test_odd_rows(docs, odd_rows):
    out = shard_documents(docs(odd_rows), shards=3).collect()
    assert len(out) == len(odd_rows)
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add((r.size, r.text_crc32))
    assert by[3] == {(1, 0)} and by[4] == {(1, 0)}
    assert shard_documents(docs([])).count() == 0
