"""Removal of repeated byte strings, exact, by a collection Burrows-Wheeler transform.

Every byte covered by a string of ``length`` bytes that also starts earlier is removed.

1. Anchors. Each window of ``length`` bytes picks its least-hashed k-gram (the leftmost
   among equals), so equal windows pick the same k-gram at the same place. Successive
   windows with one anchor form a *read*: the windows' bytes, about 1.4 windows long.
2. Only reads whose anchor occurs again can hold a repeated window. Of equal reads (same
   anchor hash and content hash, 128 bits together) the first is kept for step 3, in all others
   every window repeats.
3. First reads that share their anchor with a different read are dealt by anchor into
   bounded collections and cut to the part that another read of the anchor shares; of
   equal parts the first stays. The different parts are compared exactly: a collection gets
   its multi-string Burrows-Wheeler transform and longest-common-prefix array by
   column-wise construction. In round j the j-th symbol from the end of every read is inserted, with both arrays read from and
   written to sequential files. Neighbours in suffix order with a common prefix of
   ``length`` are equal windows; all but the earliest repeat.
   Whole long texts aren't inserted in this way: the rounds are as many as the
   longest string has symbols, and reads bound them at 2 * length.
4. Anchors with more different reads than one collection may hold are split by the windows
   themselves: a window's 128-bit hash is the key and partial aggregation finds the first.
5. Repeated windows return to their documents, which lose the bytes they cover.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import BYTE, NULL_ID, bound_batches, byte_slices, drop_table, join_counted, materialize, mix, new_path, raw_bytes, text_binary, trimmed

GRAM = 24
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of reads in a collection, and different reads of an anchor that go into one.
COLLECTION = 4 << 20
HOT_READS = 16_384


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of every k-gram, by doubling."""
    power = lambda n: np.uint64(pow(BASE, n, 2**64))
    have, width, out, done = BYTE[buf], 1, None, 0
    while True:
        if gram & width:
            if out is None:
                out, done = have, width
            else:
                n = len(buf) - done - width + 1
                out, done = have[:n] * power(done) + out[width : width + n], done + width
        if done == gram:
            return out
        n = len(buf) - 2 * width + 1
        have, width = have[:n] * power(width) + have[width : width + n], 2 * width


def sliding_least(keys: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` successive keys."""
    width, out = 1, keys
    while 2 * width <= span:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    rest = span - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def find_reads(buf: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM):
    """document, start, windows, anchor hash, content hash, anchor offset of every read of a slice.
    Slices are cut into stretches of at most 4 MB; windows never cross documents."""
    stretch, lap = 4 << 20, length - 1
    parts = []
    for at in range(0, max(1, len(buf) - lap), stretch):
        piece = buf[at : at + stretch + lap]
        if len(piece) < length:
            break
        h = gram_hashes(piece, gram)
        place = np.arange(len(h), dtype=np.uint64)
        least = sliding_least((mix(h) & ~np.uint64(0xFFFFFF)) | place, length - gram + 1)
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.arange(len(anchor)) + at
        doc = np.searchsorted(ends, start, side="right") - 1
        ok = start + length <= ends[doc + 1]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
        lo = np.flatnonzero(new & ok)
        if not len(lo):
            continue
        close = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True)) + 1
        n = close - lo
        reach = n + length - 1
        content = reach.astype(np.uint64) * np.uint64(BASE)
        for j, step in enumerate((0, gram, 2 * gram, 3 * gram, 4 * gram, 5 * gram, 6 * gram, 7 * gram, reach)):
            content = mix(content + np.uint64(j)) + h[lo + np.minimum(step, reach - gram)]
        content = mix(content + (anchor[lo] - lo).astype(np.uint64))
        parts.append((doc[lo], lo + at - ends[doc[lo]], n, mix(h[anchor[lo]]).view(np.int64), content.view(np.int64), anchor[lo] - lo))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*parts))


# --------------------------------------------------------------------------- the transform


class _Files:
    """Arrays kept in sequential files between the rounds, in a new folder below ``folder`` (a
    shared one; a task that runs again has another). Rounds write to two files by turns."""

    def __init__(self, folder: str):
        uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.folder = f"{path}/bwt-{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder, recursive=True)
        self.turn: dict[str, int] = {}

    def put(self, name: str, array: np.ndarray) -> None:
        self.turn[name] = 1 - self.turn.get(name, 0)
        with self.fs.open_output_stream(f"{self.folder}/{name}{self.turn[name]}", compression=None) as out:
            out.write(array)

    def get(self, name: str) -> np.ndarray:
        with self.fs.open_input_stream(f"{self.folder}/{name}{self.turn[name]}", compression=None) as file:
            return np.frombuffer(file.read(), np.uint8)

    def close(self) -> None:
        self.fs.delete_dir(self.folder)


def collection_bwt(data: np.ndarray, ends: np.ndarray, folder: str):
    """Transform, common prefixes and suffix order (read, suffix length) of a collection.

    ``data`` holds symbols 1..255, ``ends`` the reads' offsets; 0 marks a read's end. Reads
    have at most 254 symbols. After round j the arrays describe all suffixes of up to j symbols.
    """
    count, lengths = len(ends) - 1, np.diff(ends)
    files = _Files(folder)
    try:
        files.put("bwt", np.zeros(count, np.uint8))
        files.put("lcp", np.zeros(count, np.uint8))
        at = np.arange(count)
        live = np.arange(count)
        for j in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > j]
            bwt, lcp = files.get("bwt").copy(), files.get("lcp")
            bwt[at[live]] = data[ends[live + 1] - 1 - j]
            order = np.argsort(bwt, kind="stable")
            order = order[np.count_nonzero(bwt == 0) :]  # last-to-first: the t-th entry makes suffix count + t
            place = np.empty(len(bwt), np.int32)
            place[order] = np.arange(count, count + len(order), dtype=np.int32)
            fresh = place[at[live]].astype(np.int64)
            at[live] = fresh
            size = count + len(order)
            old = np.ones(size, bool)
            old[fresh] = False
            bwt2, lcp2 = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
            bwt2[old], lcp2[old] = bwt, lcp
            # a new suffix and the one after it get their common prefixes: one more than the
            # least between the entries that they come from, if these are the same symbol
            touched = np.zeros(size + 1, bool)
            touched[fresh] = True
            touched[fresh + 1] = True
            t = np.flatnonzero(touched[count:size])
            lcp2[t + count] = 0
            t = t[t > 0]
            a, b = order[t - 1], order[t]
            same = bwt[a] == bwt[b]
            t, a, b = t[same], a[same], b[same]
            if len(t):
                by = np.argsort(a, kind="stable")
                pairs = np.empty(2 * len(t), np.int64)
                pairs[0::2], pairs[1::2] = a[by] + 1, b[by] + 1
                least = np.minimum.reduceat(np.append(lcp, np.uint8(0)), pairs)[::2]
                lcp2[t[by] + count] = least + 1
            files.put("bwt", bwt2)
            files.put("lcp", lcp2)
        bwt, lcp = files.get("bwt"), files.get("lcp")
    finally:
        files.close()
    # walk every read through the last-to-first mapping to name the suffixes
    order = np.argsort(bwt, kind="stable")
    order = order[np.count_nonzero(bwt == 0) :]
    place = np.empty(len(bwt), np.int32)
    place[order] = np.arange(count, count + len(order), dtype=np.int32)
    owner, suffix = np.empty(len(bwt), np.int32), np.zeros(len(bwt), np.uint8)
    at, live = np.arange(count), np.arange(count)
    owner[:count] = live
    for j in range(int(lengths.max(initial=0))):
        live = live[lengths[live] > j]
        at[live] = place[at[live]]
        owner[at[live]], suffix[at[live]] = live, j + 1
    return bwt, lcp, owner, suffix


def repeated_windows(reads: list[bytes], doc: np.ndarray, start: np.ndarray, length: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(read, offset) of every window of ``length`` bytes that also starts earlier, by (doc, start)."""
    sizes = np.array([len(r) for r in reads])
    ends = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.frombuffer(b"".join(reads), np.uint8)
    alphabet = np.zeros(256, np.uint8)
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    if len(used) > 255:  # not UTF-8; the rarest symbol can't be left out, so windows are compared as such
        return _plain_windows(reads, doc, start, length)
    alphabet[used] = np.arange(1, len(used) + 1)
    _, lcp, owner, suffix = collection_bwt(alphabet[raw], ends, folder)
    group = np.cumsum(lcp < length)
    use = np.flatnonzero(suffix >= length)
    size = np.bincount(group[use])
    use = use[size[group[use]] > 1]
    offset = sizes[owner[use]] - suffix[use]
    place_doc, place_start = doc[owner[use]], start[owner[use]] + offset
    order = np.lexsort((place_start, place_doc, group[use]))
    g, d, s = group[use][order], place_doc[order], place_start[order]
    first = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
    later = (d != d[head]) | (s != s[head])
    return owner[use][order][later], offset[order][later]


def _plain_windows(reads, doc, start, length):
    first: dict[bytes, tuple] = {}
    for r, d, s in zip(reads, doc, start):
        for o in range(len(r) - length + 1):
            w = r[o : o + length]
            first[w] = min(first.get(w, (d, s + o)), (d, s + o))
    got = [(i, o) for i, r in enumerate(reads) for o in range(len(r) - length + 1) if first[r[o : o + length]] != (doc[i], start[i] + o)]
    return np.array([i for i, _ in got], np.int64), np.array([o for _, o in got], np.int64)


def shared_part(reads: list[bytes], f: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each read around its anchor, from lo to hi, that can hold a string of
    another read: as far as the longest extension to the left, and to the right, that it shares
    with any read of the anchor. Sorted by what follows the anchor (then by what comes before it,
    read backwards), the longest extension is shared with a neighbour."""
    sizes = np.array([len(r) for r in reads])
    grow = []
    for side in (0, 1):
        parts = [r[a:] for r, a in zip(reads, anchor)] if side else [r[:a][::-1] for r, a in zip(reads, anchor)]
        lengths = np.array([len(x) for x in parts])
        width = max(8, -(-int(lengths.max(initial=1)) // 8) * 8)
        table = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(len(parts), width)
        words = table.view(">u8")
        order = np.lexsort((lengths, *(words[:, j] for j in range(words.shape[1] - 1, -1, -1)), f))
        sorted_table, sorted_f, sorted_len = table[order], f[order], lengths[order]
        common = np.zeros(len(parts) + 1, np.int64)
        if len(parts) > 1:
            differs = sorted_table[1:] != sorted_table[:-1]
            first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
            first = np.minimum(first, np.minimum(sorted_len[1:], sorted_len[:-1]))
            common[1:-1] = np.where(sorted_f[1:] == sorted_f[:-1], first, 0)
        most = np.empty(len(parts), np.int64)
        most[order] = np.maximum(common[:-1], common[1:])
        grow.append(most)
    return anchor - grow[0], np.minimum(anchor + grow[1], sizes)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["f", "variants", *TEXT, "start", "anchor", "bytes"])


# --------------------------------------------------------------------------- the operator

#: A text's identity: its id, and for texts of one id 64 bits of one hash and 18 of another.
TEXT = ("doc", "th", "tc")
CHECK_BITS = (1 << 18) - 1


def _source(docs: DataFrame) -> DataFrame:
    text = text_binary()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("th"), F.crc32(text).bitwiseAND(F.lit(CHECK_BITS)).cast("int").alias("tc"), text.alias("text"))


def _pack(tc: np.ndarray, start: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The text's check, start (below 2**31), number of windows and the anchor's offset (up to
    127 each) in one long, ordered by check and start."""
    return (tc.astype(np.int64) << 45) | (start.astype(np.int64) << 14) | (windows.astype(np.int64) << 7) | anchor.astype(np.int64)


def _unpack(column: str):
    """tc, start, windows, anchor"""
    c = F.col(column)
    part = lambda shift, bits, name: F.shiftright(c, shift).bitwiseAND(F.lit(bits)).cast("int").alias(name)
    return part(45, CHECK_BITS, "tc"), part(14, 2**31 - 1, "start"), part(7, 127, "windows"), part(0, 127, "anchor")


def repeated_starts(docs: DataFrame, length: int = 100, gram: int = GRAM, hot_reads: int = HOT_READS, collection: int = COLLECTION) -> DataFrame:
    """doc, th, tc, start, windows: runs of window starts that repeat an earlier window."""
    if not (2 * gram <= length <= 120):
        raise ValueError("windows of 48 to 120 bytes are supported")
    source = _source(docs)
    kinds = "f long, rh long, doc long, th long, pack long"

    def occurrences(batches):
        for batch in batches:
            column = batch.column("text")
            doc, th, tc = (batch.column(c).to_numpy() for c in TEXT)
            for a, b in byte_slices(column):
                buf, ends = raw_bytes(column.slice(a, b - a))
                d, s, n, f, rh, p = find_reads(buf, ends, length, gram)
                if len(d):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f, rh, doc[a + d], th[a + d], _pack(tc[a + d], s, n, p))], names=["f", "rh", "doc", "th", "pack"])

    def anchors(batches):
        for batch in batches:
            column = batch.column("text")
            for a, b in byte_slices(column, 8 << 20):
                f = np.sort(find_reads(*raw_bytes(column.slice(a, b - a)), length, gram)[3])
                if len(f):
                    at = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
                    yield pa.RecordBatch.from_arrays([pa.array(f[at]), pa.array(np.minimum(np.diff(np.append(at, len(f))), 2).astype(np.int32))], names=["f", "c"])

    often = materialize(source.select("text").mapInArrow(trimmed(anchors), "f long, c int").groupBy("f").agg(F.sum("c").alias("c")).where("c > 1").select("f"), "suffix-anchors")
    matched = materialize(source.select(*TEXT, "text").mapInArrow(trimmed(occurrences), kinds).join(often, "f"), "suffix-reads")
    drop_table(often)
    del often

    firsts = materialize(matched.groupBy("f", "rh").agg(F.min(F.struct("doc", "th", "pack")).alias("first"), F.count("*").alias("c")), "suffix-firsts")
    variants = firsts.groupBy("f").agg(F.count("*").alias("variants")).where("variants > 1")
    # equal reads: all but the first repeat as a whole
    later = join_counted(matched, firsts.where("c > 1"), ["f", "rh"], matched.count()).where("doc <> first.doc or th <> first.th or pack <> first.pack")
    tc, start, windows, _ = _unpack("pack")
    whole = later.select("doc", "th", tc, start, windows)

    # different reads of one anchor: fetch their bytes
    compare = firsts.join(variants, "f").select("f", "variants", "first.doc", "first.th", *_unpack("first.pack"))
    by_doc = compare.groupBy(*TEXT).agg(F.collect_list(F.struct("f", "variants", "start", "windows", "anchor")).alias("reads"))

    def fetch(batches):
        for batch in batches:
            rows = []
            text, reads = batch.column("text"), batch.column("reads")
            names = list(zip(*(batch.column(c).to_pylist() for c in TEXT)))
            for i in range(batch.num_rows):
                data = text[i].as_buffer().to_pybytes()
                for r in reads[i].as_py():
                    rows.append((r["f"], r["variants"], *names[i], r["start"], r["anchor"], data[r["start"] : r["start"] + r["windows"] + length - 1]))
                    if len(rows) >= 20_000:
                        yield _read_batch(rows)
                        rows = []
            if rows:
                yield _read_batch(rows)

    reads = source.select(*TEXT, "text").join(by_doc, list(TEXT)).select(*TEXT, "text", "reads").mapInArrow(trimmed(fetch), "f long, variants long, doc long, th long, tc int, start int, anchor int, bytes binary")
    reads = materialize(reads, "suffix-compare")
    volume = reads.where(F.col("variants") <= hot_reads).agg(F.sum(F.length("bytes"))).first()[0] or 0
    collections = max(1, -(-volume // collection))
    folder = new_path(docs.sparkSession, "suffix-files")

    def transform(table):
        data = table.column("bytes").to_pylist()
        f, doc, th, tc, start, anchor = (table.column(c).combine_chunks().to_numpy().astype(np.int64) for c in ("f", *TEXT, "start", "anchor"))
        lo, hi = shared_part(data, f, anchor)
        # texts by number, in their order
        by = np.lexsort((tc, th, doc))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (doc[by][1:] != doc[by][:-1]) | (th[by][1:] != th[by][:-1]) | (tc[by][1:] != tc[by][:-1])
        text = np.empty(len(by), np.int64)
        text[by] = np.cumsum(fresh)
        out = []
        # equal shared parts: all but the first repeat as a whole, the first stands for them
        seen: dict[tuple, int] = {}
        use = np.flatnonzero(hi - lo >= length)
        for i in use[np.lexsort((start[use] + lo[use], text[use]))]:
            key = (f[i], data[i][lo[i] : hi[i]])
            j = seen.setdefault(key, i)
            if text[j] != text[i] or start[j] + lo[j] != start[i] + lo[i]:
                out.append((doc[i], th[i], tc[i], start[i] + lo[i], hi[i] - lo[i] - length + 1))
        count: dict[int, int] = {}
        for g, _ in seen:
            count[g] = count.get(g, 0) + 1
        left = [(i, part) for (g, part), i in seen.items() if count[g] > 1]
        if left:
            at = np.array([i for i, _ in left])
            owner, offset = repeated_windows([part for _, part in left], text[at], (start + lo)[at], length, folder)
            order = np.lexsort((offset, owner))
            owner, offset = owner[order], offset[order]
            new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)))) if len(owner) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(owner)))
            o = at[owner[new]]
            out += zip(doc[o], th[o], tc[o], (start + lo)[o] + offset[new], n)
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(np.array(c, np.int64)).cast(t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=[*TEXT, "start", "windows"])

    cool = reads.where(F.col("variants") <= hot_reads).withColumn("part", F.pmod(F.xxhash64("f"), F.lit(collections)))
    exact = cool.select("part", "f", *TEXT, "start", "anchor", "bytes").groupBy("part").applyInArrow(transform, "doc long, th long, tc int, start int, windows int")

    # anchors with more reads than a collection takes: window by window
    hot = reads.where(F.col("variants") > hot_reads).select(*TEXT, F.col("start").alias("at"), "bytes", F.explode(F.expr(f"sequence(1, length(bytes) - {length - 1})")).alias("o"))
    hot = hot.select(*TEXT, (F.col("at") + F.col("o") - 1).alias("start"), F.md5(F.substring("bytes", F.col("o"), F.lit(length))).alias("w"))
    lead = hot.groupBy("w").agg(F.min(F.struct(*TEXT, "start")).alias("first"), F.count("*").alias("c")).where("c > 1")
    split = hot.join(lead, "w").where("struct(doc, th, tc, start) <> first").select(*TEXT, "start", F.lit(1).alias("windows"))
    return whole.union(exact).union(split)


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``keep_text`` also
    the bytes that remain (they may cut a character).

    Rows with one doc_id and one text are one document: they are treated alike and lose nothing
    to each other. Different texts under one doc_id (or under none) are documents of their own,
    in the order of a hash of the text. A null id comes before all others. Null texts are empty; texts shorter than ``length`` lose
    nothing. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    source = _source(docs)
    runs = repeated_starts(docs, length, **options)
    gathered = runs.groupBy(*TEXT).agg(F.collect_list(F.struct("start", "windows")).alias("runs"))

    def cut(batches):
        for batch in batches:
            text, runs = batch.column("text"), batch.column("runs")
            lengths, removed, spans, digests, kept = [], [], [], [], []
            flat = runs.flatten()
            starts, counts = flat.field("start").to_numpy(), flat.field("windows").to_numpy()
            edges = np.concatenate(([0], np.cumsum([len(r) if r.is_valid else 0 for r in runs])))
            for i in range(batch.num_rows):
                data = np.frombuffer(text[i].as_buffer(), np.uint8)
                s, n = starts[edges[i] : edges[i + 1]].astype(np.int64), counts[edges[i] : edges[i + 1]].astype(np.int64)
                lengths.append(len(data))
                if len(s):
                    change = np.zeros(len(data) + 1, np.int64)
                    np.add.at(change, s, 1)
                    np.add.at(change, s + n + length - 1, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    data = data[~gone]
                else:
                    removed.append(0)
                    spans.append(0)
                rest = data.tobytes()
                digests.append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    kept.append(rest)
            cols = [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_text, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return source.join(gathered, list(TEXT), "left").select("doc_id", "text", "runs").mapInArrow(trimmed(cut), kinds)
