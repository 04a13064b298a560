"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a segment (a word, without surrounding signs, in lower
case) in both directions and gives language probabilities at every position; a document
pools them: the mean over all positions of all its segments. It is written in numpy and
trained by backpropagation through time on a bounded sample of labelled rows. As a
segment's probabilities don't depend on its neighbours, each distinct segment is worked
out once for a batch of documents and remembered.
"""

from __future__ import annotations

import threading
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm._common import bound_batches, byte_slices, trimmed

#: Labelled documents of a language that training may use, and of all languages (one each at least).
SAMPLE_DOCS = 400
SAMPLE_ALL = 25_600
#: Characters of a labelled text that training may use (texts are predicted whole).
SAMPLE_CHARS = 1 << 15
#: Bytes of a segment; longer words are read in pieces.
SEGMENT = 32
HIDDEN = 16
FOLDS = 5
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha()) + " «»–—‘’“”…¿¡"

Model = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def new_model(languages: int, hidden: int = HIDDEN, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    model = {}
    for way in "fb":
        model["x" + way] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        model["h" + way] = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        model["c" + way] = np.zeros(3 * hidden, np.float32)
    model["out"] = rng.normal(0, 0.3, (2 * hidden, languages)).astype(np.float32)
    model["bias"] = np.zeros(languages, np.float32)
    return model


def _scan(model: Model, way: str, x: np.ndarray, keep: bool):
    """States of one direction over segments ``x`` (time, segments), with what the backward pass needs."""
    wx, wh, hidden = model["x" + way] + model["c" + way], model["h" + way], model["h" + way].shape[0]
    h = np.zeros((x.shape[1], hidden), np.float32)
    states, saved = np.empty((*x.shape, hidden), np.float32), []
    for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
        g = wx[x[t]]
        a = h @ wh[:, : 2 * hidden]
        a += g[:, : 2 * hidden]
        rz = _sigmoid(a)
        r, z = rz[:, :hidden], rz[:, hidden:]
        u = h @ wh[:, 2 * hidden :]
        n = np.tanh(g[:, 2 * hidden :] + r * u)
        if keep:
            saved.append((t, h, r, z, u, n))
        h = n + z * (h - n)
        states[t] = h
    return states, saved


def position_probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities (time, segments, languages) for segments of one length."""
    both = np.concatenate([_scan(model, "f", x, False)[0], _scan(model, "b", x, False)[0]], axis=2)
    score = both @ model["out"] + model["bias"]
    score -= score.max(axis=2, keepdims=True)
    np.exp(score, out=score)
    return score / score.sum(axis=2, keepdims=True)


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, Model]:
    """Mean cross-entropy over all positions, and its gradient by backpropagation through time."""
    fs, fk = _scan(model, "f", x, True)
    bs, bk = _scan(model, "b", x, True)
    both = np.concatenate([fs, bs], axis=2)
    score = both @ model["out"] + model["bias"]
    score -= score.max(axis=2, keepdims=True)
    p = np.exp(score)
    p /= p.sum(axis=2, keepdims=True)
    rows = np.arange(x.shape[1])
    loss = float(-np.log(p[:, rows, y] + 1e-9).mean())
    p[:, rows, y] -= 1
    p /= x.size
    flat = both.reshape(-1, both.shape[2])
    grad = {"out": flat.T @ p.reshape(-1, p.shape[2]), "bias": p.sum(axis=(0, 1))}
    back = p @ model["out"].T
    hidden = fs.shape[2]
    for way, saved, part in (("f", fk, back[..., :hidden]), ("b", bk, back[..., hidden:])):
        wh = model["h" + way]
        gx, gh, dh = np.zeros_like(model["x" + way]), np.zeros_like(wh), np.zeros((x.shape[1], hidden), np.float32)
        for t, h, r, z, u, n in reversed(saved):
            dh = dh + part[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * u * r * (1 - r)
            du = dn * r
            da = np.concatenate([dr, dz], axis=1)
            np.add.at(gx, x[t], np.concatenate([da, dn], axis=1))
            gh[:, : 2 * hidden] += h.T @ da
            gh[:, 2 * hidden :] += h.T @ du
            dh = dh * z + da @ wh[:, : 2 * hidden].T + du @ wh[:, 2 * hidden :].T
        grad["x" + way], grad["h" + way], grad["c" + way] = gx, gh, gx.sum(axis=0)
    return loss, grad


def train(segments: list[bytes], labels: np.ndarray, weights: np.ndarray, languages: int, steps: int = 1500, batch: int = 256, rate: float = 0.01, seed: int = 11) -> Model:
    """Adam over batches of segments of one length, drawn by weight."""
    rng = np.random.default_rng(seed)
    model = new_model(languages)
    lengths = np.array([len(s) for s in segments])
    groups = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        x = np.frombuffer(b"".join(segments[i] for i in at), np.uint8).reshape(len(at), n)
        w = weights[at]
        groups[int(n)] = (x, labels[at], np.cumsum(w) / w.sum(), w.sum() * n)
    sizes = sorted(groups)
    share = np.array([groups[n][3] for n in sizes], float)
    share = np.cumsum(share) / share.sum()
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, y, cum, _ = groups[sizes[min(int(np.searchsorted(share, rng.random())), len(sizes) - 1)]]
        at = np.minimum(np.searchsorted(cum, rng.random(batch)), len(x) - 1)
        _, grad = gradients(model, x[at].T, y[at])
        lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model[k] -= (lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# --------------------------------------------------------------------------- segments


def words_of(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words that hold letters, the code of each word of the texts (-1:
    no letters), and the texts' bounds among them."""
    split = pc.utf8_split_whitespace(column)
    bounds = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    bare = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=SIGNS)
    bare = pc.if_else(pc.match_substring_regex(bare, r"\pL"), bare, pa.scalar(None, bare.type))
    again = bare.dictionary_encode()
    to = again.indices.fill_null(-1).to_numpy().astype(np.int64)
    codes = to[coded.indices.to_numpy()] if len(to) else np.zeros(0, np.int64)
    return again.dictionary.to_pylist(), codes, bounds - bounds[0]


def pieces(word: str) -> list[bytes]:
    raw = word.encode("utf-8", "replace")
    return [raw[i : i + SEGMENT] for i in range(0, len(raw), SEGMENT)]


class Scorer:
    """Summed position probabilities by word, and the greatest language's sum of each of its
    segments, remembered for at most ``remember`` words."""

    def __init__(self, model: Model, remember: int = 200_000):
        self.model, self.languages = model, model["out"].shape[1]
        self.known: dict[str, int] = {}
        self.sums = np.zeros((remember, self.languages + 1), np.float32)
        self.sizes = np.zeros(remember, np.int32)

    def _fill(self, words: list[str]) -> None:
        base = len(self.known)
        by_length: dict[int, list] = {}
        for i, w in enumerate(words):
            self.known[w] = base + i
            for piece in pieces(w):
                by_length.setdefault(len(piece), []).append((base + i, piece))
        self.sums[base : base + len(words)] = 0
        self.sizes[base : base + len(words)] = 0
        for n, got in by_length.items():
            for at in range(0, len(got), 4096):
                some = got[at : at + 4096]
                rows = np.array([i for i, _ in some])
                x = np.frombuffer(b"".join(p for _, p in some), np.uint8).reshape(len(some), n).T
                summed = position_probabilities(self.model, x).sum(axis=0)
                np.add.at(self.sums, rows, np.concatenate([summed, summed.max(axis=1, keepdims=True)], axis=1))
                np.add.at(self.sizes, rows, n)

    def score(self, column: pa.Array) -> np.ndarray:
        """Mean position probabilities by text; all 0 where there are no letters."""
        return self.rate(column)[:, :-1]

    def rate(self, column: pa.Array) -> np.ndarray:
        """The same, and last the certainty: as the mean, but of each segment's own greatest
        language. Texts of several learned languages have a low score, but a high certainty."""
        distinct, codes, bounds = words_of(column)
        width = self.languages + 1
        out = np.zeros((len(column), width + 1))
        limit = len(self.sizes)
        # more words than are remembered at once: one share of them after the other
        for at in range(0, max(len(distinct), 1), limit):
            some = distinct[at : at + limit]
            missing = [w for w in some if w not in self.known]
            if len(self.known) + len(missing) > limit:
                self.known.clear()
                missing = some
            self._fill(missing)
            rows = np.fromiter((self.known[w] for w in some), np.int64, len(some))
            mine = np.flatnonzero((codes >= at) & (codes < at + len(some)))
            text = np.searchsorted(bounds, mine, side="right") - 1
            row = rows[codes[mine] - at]
            for j in range(width):
                out[:, j] += np.bincount(text, self.sums[row, j], len(column))
            out[:, -1] += np.bincount(text, self.sizes[row], len(column))
        return out[:, :-1] / np.maximum(out[:, -1:], 1)


_LOCAL = threading.local()


def _scorer(key: int, sent) -> Scorer | None:
    """One scorer a worker, with what it remembers, as long as the model stays."""
    if getattr(_LOCAL, "key", None) != key:
        _LOCAL.scorer, _LOCAL.key = Scorer(sent.value) if sent.value is not None else None, key
    return _LOCAL.scorer


def held_out(doc_id: str = "doc_id"):
    """Rows whose remainder is 0 are never learned from; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = 1500, sample_chars: int = SAMPLE_CHARS, sample_all: int = SAMPLE_ALL) -> tuple[list[str], Model | None]:
    """All non-null languages and the network. It learns from at most ``sample_docs`` labelled
    documents of each language (fewer, if these were more than ``sample_all``; one at least),
    drawn by a hash of doc_id, none held out; of longer texts from ``sample_chars`` characters,
    from a place drawn likewise."""
    labelled = docs.select(F.col("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = labelled.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return [], None
    languages = sorted(r["lang"] for r in counts)
    sample_docs = max(1, min(sample_docs, sample_all // len(languages)))
    hashed = lambda use: F.crc32(F.concat(F.lit(use), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")) / float(2**32)
    # somewhat more than the bound is drawn, so that it is met
    share = {r["lang"]: (1.2 * sample_docs + 10) / r["count"] for r in counts}
    chance = F.element_at(F.create_map(*[x for name, c in share.items() for x in (F.lit(name), F.lit(c))]), F.col("lang"))
    most = int(sum(min(r["count"], 1.5 * sample_docs + 40) for r in counts))
    room = F.length("text") - sample_chars
    piece = F.when(room > 0, F.substring("text", (hashed("place:") * (room + 1)).cast("int") + 1, F.lit(sample_chars))).otherwise(F.col("text"))
    rows = labelled.withColumn("draw", hashed("draw:")).where(F.col("draw") < chance).select("doc_id", piece.alias("text"), "lang", "draw").orderBy("draw", "doc_id").limit(most).collect()
    tally: dict[tuple, int] = {}
    taken: dict[str, int] = {}
    for r in rows:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] > sample_docs:
            continue
        distinct, codes, _ = words_of(pa.array([r["text"]]))
        for code, n in enumerate(np.bincount(codes[codes >= 0], minlength=len(distinct))):
            for piece in pieces(distinct[code]):
                key = (piece, languages.index(r["lang"]))
                tally[key] = tally.get(key, 0) + int(n)
    if not tally:
        return [], None
    keys = sorted(tally)
    labels = np.array([k[1] for k in keys])
    weights = np.array([tally[k] for k in keys], float)
    by_language = np.bincount(labels, weights, len(languages))
    weights /= by_language[labels]  # languages count alike
    return languages, train([k[0] for k in keys], labels, weights, len(languages), steps)


def predict(docs: DataFrame, languages: list[str], model: Model | None, *carry: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and certainty of every row; the columns ``carry``
    instead of the first two."""
    spark = docs.sparkSession
    bound_batches(spark)
    own = "text" if "text" in carry else "_text"  # a carried text isn't sent twice
    base = docs.select(*carry, F.col("doc_id").alias("_doc"), held_out().alias("_held"), *([] if "text" in carry else [F.col("text").alias("_text")]))
    kept = base.schema if "text" in carry else base.drop("_text").schema
    sent = spark.sparkContext.broadcast(model)
    key = zlib.crc32(b"".join(model[k].tobytes() for k in sorted(model))) if model else 0

    def run(batches):
        scorer = _scorer(key, sent)
        for batch in batches:
            whole = batch.column(own).fill_null("")
            for at, to in byte_slices(whole, 6 << 20):
                some, n = batch.slice(at, to - at), to - at
                if scorer is None:
                    best, top, sure = np.zeros(n, int), np.zeros(n), np.zeros(n)
                else:
                    rated = scorer.rate(whole.slice(at, n))
                    p, sure = rated[:, :-1], np.minimum(rated[:, -1], 1.0)
                    best, top = p.argmax(axis=1), np.minimum(p.max(axis=1), 1.0)
                names = [languages[b] if s > 0 else "und" for b, s in zip(best, top)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept.names), pa.array(names, pa.string()), pa.array(top.astype(float)), pa.array(sure.astype(float))], names=[*kept.names, "_pred", "_score", "_sure"])
        if scorer is not None:
            scorer.known.clear()

    schema = T.StructType([*kept.fields, T.StructField("_pred", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_sure", T.DoubleType())])
    out = base.mapInArrow(trimmed(run), schema)
    return out.select(*(carry or [F.col("_doc").cast("long").alias("doc_id"), F.col("_held").alias("held_out")]), F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_sure").alias("certainty"))


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``.

    The network learns from text and non-null lang of rows that aren't held out; the
    prediction sees the text alone. ``und`` with score 0: the text is null, has no letters, or
    nothing could be learned. Null ids fall in one fold; repeated rows get equal results.
    """
    languages, model = fit(docs, sample_docs)
    return predict(docs, languages, model).drop("certainty")
