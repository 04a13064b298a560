from collections import Counter
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm.mixing import deal, deviation, mix_documents, one_period, plan_phases, quantize, window


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
def test_every_prefix_is_within_a_block(parts):
    period = sum(parts)
    slots = one_period(parts)
    owner = {t: s for s, at in enumerate(slots) for t in at.tolist()}
    assert sorted(owner) == list(range(period))
    dealt = Counter()
    for t in range(period):
        dealt[owner[t]] += 1
        assert all(abs(dealt[s] - Fraction(k, period) * (t + 1)) < 1 for s, k in enumerate(parts))
    for s, at in enumerate(slots):
        for i, t in enumerate(at.tolist()):
            release, due = window(i, parts[s], period)
            assert release <= t < due


def brute(blocks, weights, resolution):
    """Slot by slot, phase by phase: the definition."""
    left = {s: list(range(b)) for s, b in enumerate(blocks) if b}
    out, start = {}, 0
    while left:
        names = sorted(left)
        parts = quantize([weights[s] for s in names], max(resolution, 2 * len(names)))
        period, t, done = sum(parts), 0, dict.fromkeys(names, 0)
        while all(left[s] for s in names):
            ready = [(window(done[s], k, period), s) for s, k in zip(names, parts) if window(done[s], k, period)[0] <= t]
            s = min(ready, key=lambda x: (x[0][1], x[1]))[1]
            out[s, left[s].pop(0)] = start + t
            done[s] += 1
            t += 1
        start += t
        left = {s: x for s, x in left.items() if x}
    return out


def test_phases_match_the_simulation():
    blocks, weights = [9, 40, 3, 17], [5.0, 1.0, 2.0, 0.5]
    got = {}
    for p in plan_phases(blocks, weights, 60):
        for s, k, at, first, stop in zip(p["sources"], p["parts"], p["slots"], p["first"], p["stop"]):
            for i in range(first, stop):
                got[s, i] = p["start"] + (i - first) // k * p["period"] + int(at[(i - first) % k])
    assert got == brute(blocks, weights, 60)
    assert sorted(got.values()) == list(range(sum(blocks)))


def test_query_places_every_row_once(docs):
    rows = [(i, "t", "en", "hot" if i % 3 else f"s{i % 4}") for i in range(500)]
    out = mix_documents(docs(rows), weights={"hot": 1.0, "s0": 2.0}, block_rows=4).collect()
    assert sorted(r.position for r in out) == list(range(500))
    assert {r.doc_id for r in out} == set(range(500))
    first = [r for r in out if r.phase == 0]
    slots = {(r.source if r.source in ("hot", "s0") else "pool", r.block): r.slot for r in first}
    assert len(set(slots.values())) == len(slots)
    last = max(slots.values()) + 1
    dealt = Counter(s for s, _ in slots)
    assert abs(dealt["s0"] - last * 0.5) < 1.01 and abs(dealt["hot"] - last * 0.25) < 1.01


def test_odd_rows(docs, odd_rows):
    out = mix_documents(docs(odd_rows), block_rows=2).collect()
    assert sorted(r.position for r in out) == list(range(len(odd_rows)))
    assert mix_documents(docs([])).count() == 0


def simulated(blocks, weights):
    """Slot by slot with exact fractions: earliest deadline, then greatest weight."""
    left, out, start = {s: list(range(b)) for s, b in enumerate(blocks) if b}, {}, 0
    while left:
        share = {s: Fraction(weights[s]) / sum(Fraction(weights[x]) for x in left) for s in left}
        done, t = dict.fromkeys(left, 0), 0
        while all(left.values()):
            due = {s: -(-Fraction(done[s] + 1) // share[s]) for s in left if done[s] // share[s] <= t}
            s = min(due, key=lambda x: (due[x], -weights[x], x))
            out[s, left[s].pop(0)] = (done[s] // share[s], due[s], start + t)
            done[s], t = done[s] + 1, t + 1
        start, left = start + t, {s: x for s, x in left.items() if x}
    return out


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 30), st.floats(1e-6, 1e3)), min_size=1, max_size=8))
def test_dealing_matches_the_exact_definition(sources):
    blocks, weights = [b for b, _ in sources], [w for _, w in sources]
    plan, _, _ = deal(blocks, weights)
    keys = [(s, i) for s, b in enumerate(blocks) for i in range(b)]
    want = simulated(blocks, weights)
    assert {k: (r, d, t) for k, r, d, t in zip(keys, plan["release"], plan["deadline"], plan["slot"])} == want
    assert sorted(plan["slot"].tolist()) == list(range(sum(blocks)))


def test_many_slots_stay_within_a_block_of_exact_weights():
    weights = {"a": 3**0.5, "b": 2**0.5, "c": 0.00007, "d": 1.0}
    total = sum(Fraction(w) for w in weights.values())
    blocks = [50_000, 50_000, 50_000, 50_000]
    plan, starts, _ = deal(blocks, list(weights.values()))
    end = starts[1]
    dealt = [(int(t), "abcd"[k // 50_000]) for k, t in enumerate(plan["slot"]) if t < end]
    assert end > 100_000
    assert deviation(dealt, {s: Fraction(w) / total for s, w in weights.items()}) < 1


def test_every_source_has_its_own_share(docs):
    weights = {f"s{i:03}": float(i + 1) for i in range(300)}
    out = mix_documents(docs([(i, "t", "en", f"s{i % 300:03}") for i in range(900)]), weights=weights, block_rows=1).collect()
    assert sorted(r.position for r in out) == list(range(900))
    total = sum(Fraction(w) for w in weights.values())
    first = [r for r in out if r.phase == 0]
    assert all((r.release, r.deadline) == (window(r.block, int(weights[r.source]), int(total))) for r in first)
    assert Counter(r.source for r in out if r.block < 3) == Counter({s: 3 for s in weights})


def test_weight_zero_comes_last(docs):
    out = mix_documents(docs([(i, "t", "en", "ab"[i % 2]) for i in range(40)]), weights={"a": 1.0, "b": 0.0}, block_rows=4).collect()
    assert [r.source for r in sorted(out, key=lambda r: r.position)] == ["a"] * 20 + ["b"] * 20
