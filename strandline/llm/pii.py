"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay. Looser patterns add candidates:
e-mail addresses with spelled-out signs, phone numbers without a plus, card numbers with dots.
Four labelers vote on every candidate (yes, no, or abstain): the strict pattern, a
gazetteer, the words before it, and its form. Votes and binary features are counted over the
whole corpus; the patterns are few, so their counts fit the driver whatever the corpus.
Expectation-maximisation on the vote counts estimates each labeler's reliability by kind,
and a logistic span classifier is trained on the features against the resulting
probabilities. Candidates that it accepts join the base spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import bound_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
GROUPS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# fixed values: public name lists
DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch at be se no dk fi pl".split())
CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 98".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35")
CUES = {
    "email": frozenset("mail email e-mail contact write correo courriel kontakt".split()),
    "ip": frozenset("ip address host server addr adresse direccion".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta".split()),
    "phone": frozenset("phone tel call mobile fax cell telefon telephone telefono".split()),
}
AGAINST = frozenset("version v release section chapter figure table isbn order no nr id".split())

LOOSE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64}[\x20]?(?:\(at\)|\[at\]|\{at\})[\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?(?:\(dot\)|\[dot\]|\{dot\}|\.)[\x20]?[A-Za-z0-9-]{1,63}){1,4}"),
    "phone": re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.-])[0-9]{4}(?:\.[0-9]{4}){3}(?![\w-]|\.[0-9])"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outward, in linear time."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for m in GROUPS.finditer(text):
        groups, at, spans = m.group().split("."), m.start(), []
        for g in groups:
            spans.append((at, at + len(g)))
            at += len(g) + 1
        for i in range(0, len(groups) - 3, 4):
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in groups[i : i + 4]):
                out.append((spans[i][0], spans[i + 3][1]))
    return out


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    out += [("ip", a, b) for a, b in addresses(text)]
    out += [("card", a, b) for a, b in cards(text)]
    if "+" in text:
        out += [("phone", a, b) for a, b in phones(text)]
    return out


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Base spans, and looser ones that touch none of them; the flag marks base spans."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    # spans of different kinds may overlap: the furthest end up to each
    firsts, reach, far = [a for a, _ in taken], [], 0
    for _, b in taken:
        reach.append(far := max(far, b))
    out = [(k, a, b, True) for k, a, b in base]
    for kind, pattern in LOOSE.items():
        for m in pattern.finditer(text):
            at = bisect_left(firsts, m.end())
            if not at or reach[at - 1] <= m.start():
                out.append((kind, m.start(), m.end(), False))
    return out


def _before(text: str, start: int) -> list[str]:
    return re.findall(r"[^\W\d_][\w-]*", text[max(0, start - 40) : start].lower())[-3:]


def votes(text: str, kind: str, a: int, b: int, strict: bool) -> tuple[int, int, int, int]:
    """Of the pattern, gazetteer, context and form labelers: 1 yes, 0 no, 2 abstain."""
    span, digits = text[a:b], _digits(text[a:b])
    cues = _before(text, a)
    context = 1 if CUES[kind] & set(cues) else 0 if AGAINST & set(cues) else 2
    if kind == "email":
        tail = re.split(r"[^A-Za-z0-9]+", span.lower())[-1]
        gazetteer, form = int(tail in DOMAINS), 1 if re.match(r"[A-Za-z0-9]", span) else 0
    elif kind == "ip":
        gazetteer = 2 if digits[:1] != "0" else 0
        form = 1 if not (a and text[a - 1] in "._") and text[b : b + 1] != "_" else 0
    elif kind == "card":
        gazetteer, form = int(digits.startswith(ISSUERS)), int(luhn(digits) and len(set(digits)) > 2)
    else:
        gazetteer = int(digits.startswith(CALLING)) if span[0] == "+" else 2
        form = 1 if re.search(r"[\x20().-]", span) and len(set(digits)) > 2 else 0
    return int(strict), gazetteer, context, form


def features(text: str, kind: str, a: int, b: int) -> int:
    """Binary features of a span as a bit set; they look at the span, not at the votes."""
    span, digits = text[a:b], _digits(text[a:b])
    bits = (
        bool(re.search(r"[\x20]", span)),
        "." in span,
        "-" in span,
        bool(re.search(r"[()\[\]{}]", span)),
        luhn(digits) if digits else False,
        len(digits) >= 13,
        bool(CUES[kind] & set(_before(text, a))),
        bool(AGAINST & set(_before(text, a))),
        a == 0 or text[a - 1].isspace(),
        b == len(text) or not text[b].isalnum(),
    )
    return sum(1 << i for i, x in enumerate(bits) if x)


N_FEATURES = 10


def estimate(counts: dict[tuple, int], rounds: int = 50) -> dict[str, tuple[float, np.ndarray]]:
    """By kind: the share of true spans and each labeler's chances of yes, no and abstention
    given a true and a false span, by expectation-maximisation from labelers taken as 80 % right."""
    out = {}
    for kind in KINDS:
        table = [(v, c) for (k, v, _), c in counts.items() if k == kind]
        if not table:
            continue
        vote = np.array([v for v, _ in table])
        weight = np.array([c for _, c in table], float)
        rate = np.zeros((2, vote.shape[1], 3))
        rate[1], rate[0] = (0.15, 0.6, 0.25), (0.6, 0.15, 0.25)
        prior = 0.7
        for _ in range(rounds):
            log = np.stack([np.log(1 - prior) + sum(np.log(rate[0, j, vote[:, j]]) for j in range(vote.shape[1])), np.log(prior) + sum(np.log(rate[1, j, vote[:, j]]) for j in range(vote.shape[1]))])
            p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            for y, q in ((1, p), (0, 1 - p)):
                for j in range(vote.shape[1]):
                    for x in range(3):
                        rate[y, j, x] = (weight * q)[vote[:, j] == x].sum() + (2.0 if (x == 1) == bool(y) and x < 2 else 0.5)
                    rate[y, j] /= rate[y, j].sum()
            prior = float(np.clip((weight * p).sum() / weight.sum(), 0.01, 0.99))
        out[kind] = (prior, rate)
    return out


def posterior(model: dict, kind: str, vote: tuple) -> float:
    prior, rate = model[kind]
    log = np.log(1 - prior) - np.log(prior) + sum(np.log(rate[0, j, v]) - np.log(rate[1, j, v]) for j, v in enumerate(vote))
    return float(1 / (1 + np.exp(np.clip(log, -50, 50))))


def train(counts: dict[tuple, int], model: dict, steps: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of the span classifier (kinds, then features) by Newton's method on all patterns."""
    keys = sorted(counts)
    x = np.array([_row(k, f) for k, _, f in keys], float).reshape(len(keys), len(KINDS) + N_FEATURES)
    y = np.array([posterior(model, k, v) for k, v, _ in keys])
    n = np.array([counts[k] for k in keys], float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + ridge * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    return w


def _row(kind: str, bits: int) -> list[float]:
    return [float(kind == k) for k in KINDS] + [float(bits >> i & 1) for i in range(N_FEATURES)]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _worth(column: pa.Array) -> np.ndarray:
    """Texts with any sign that a pattern needs."""
    return pc.match_substring_regex(column, r"[0-9@]|[\(\[\{]at[\)\]\}]").to_numpy(zero_copy_only=False)


def vote_counts(docs: DataFrame) -> dict[tuple, int]:
    """(kind, votes, features) -> number of candidates, over all documents."""

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            seen: dict[tuple, int] = {}
            for i in np.flatnonzero(_worth(column)):
                text = column[int(i)].as_py()
                for kind, a, b, strict in candidates(text):
                    key = (kind, *votes(text, kind, a, b, strict), features(text, kind, a, b))
                    seen[key] = seen.get(key, 0) + 1
            cols = list(zip(*((*k, c) for k, c in seen.items()))) if seen else [[]] * 7
            types = (pa.string(), *[pa.int32()] * 5, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["kind", "v0", "v1", "v2", "v3", "bits", "c"])

    found = _source(docs).select("text").mapInArrow(run, "kind string, v0 int, v1 int, v2 int, v3 int, bits int, c long")
    rows = found.groupBy("kind", "v0", "v1", "v2", "v3", "bits").agg(F.sum("c").alias("c")).collect()  # bounded by the patterns
    return {(r["kind"], (r["v0"], r["v1"], r["v2"], r["v3"]), r["bits"]): r["c"] for r in rows}


def find_personal_data(docs: DataFrame, accept: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans of every row.

    The counts by kind and the digest are of the base spans; ``spans`` (``n_spans`` of them) holds base and accepted spans as
    kind:start:end by kind, then start, joined by commas (code points, end exclusive). A null
    text is empty. Repeated rows repeat results and count as often in the statistics; null ids
    are returned as null; other columns are ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    counts = vote_counts(docs)
    model = estimate(counts)
    weights = train(counts, model) if counts else np.zeros(len(KINDS) + N_FEATURES)

    def accepted(text, kind, a, b):
        return 1 / (1 + np.exp(-np.dot(weights, _row(kind, features(text, kind, a, b))))) >= accept

    nothing = hashlib.sha256(b"").hexdigest()

    def write(spans):
        return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            n = {k: np.zeros(batch.num_rows, np.int64) for k in KINDS}
            digest, spans, total = [nothing] * batch.num_rows, [""] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for i in np.flatnonzero(_worth(column)):
                text = column[int(i)].as_py()
                found = candidates(text)
                base = [s[:3] for s in found if s[3]]
                for kind, _, _ in base:
                    n[kind][i] += 1
                digest[i] = hashlib.sha256(write(base).encode()).hexdigest()
                everything = base + [s[:3] for s in found if not s[3] and accepted(text, *s[:3])]
                spans[i], total[i] = write(everything), len(everything)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(n[k]) for k in KINDS), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(total)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return _source(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
