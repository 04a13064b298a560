"""Token ids in binary shards with a keyed index.

Format. A store is a folder: ``ids-NNNNN.bin`` are raw payloads, little-endian unsigned
16-bit ids if the vocabulary allows, else 32-bit, the documents one after another;
``index-NNNNN.mph`` are the parts of a minimal perfect hash index; ``manifest.json`` holds
the widths, the ids of each shard before it and the number of parts. An index part maps
each of its keys to its own number 0..n-1, and under that number stores a 32-bit
fingerprint of the key, the shard, the offset in ids within the shard and the ids' count.
Access by key reads one slot of one part and one range of one shard, whatever the size.

A key is (doc_id, occurrence): the occurrence counts repeated ids from 0 in the order of
the store; null ids have the occurrences -1, -2, ...
"""

from __future__ import annotations

import json
import struct
import threading
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm._common import bound_batches, byte_slices, drop_table, materialize, mix, new_path, trimmed

KEYS_A_PART = 1 << 15
GAMMA = 2.0
#: Ids of a shard that one task reads back.
STRETCH_BITS = 24
MAGIC = b"MPHIDX01"
_LOCAL = threading.local()


def _open(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + (path[5:] if path.startswith("file:") else path))


def _write(folder: str, name: str, data: bytes) -> None:
    """Whole files appear at once, so a task that runs again leaves the same file."""
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    hidden = f"{path}/.{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    with fs.open_output_stream(hidden, compression=None) as out:
        out.write(data)
    _place(fs, hidden, f"{path}/{name}")


def _place(fs, hidden: str, path: str) -> None:
    """Name a whole file; what an earlier attempt of the task left there is the same and goes first."""
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(hidden, path)


def _read(folder: str, name: str) -> bytes:
    fs, path = _open(folder)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
        return f.read()


# --------------------------------------------------------------------------- encoding


class WordEncoder:
    """Encodes texts whose tokens never span ASCII white space, for a tokenizer that lower-cases
    and marks the last token of a pre-token with ``</w>``.

    Distinct words are encoded by the tokenizers library once and remembered, at most
    ``remember`` of them. ASCII capitals are lowered first, and stops at the end of a word are
    encoded apart where a letter or digit stands before them, as the pre-tokenizer cuts there
    in any case. Words of letters are sent to the library many in a text: each is one
    pre-token, so the marks tell them apart; where their number doesn't fit, one by one.
    """

    STOPS = ".,;:!?"

    def __init__(self, path: str, remember: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words))))
        while len(self.known) > len(self.size):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[base : base + len(words)] = sizes
        self.first[base : base + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _learn(self, words: list[str], letters: np.ndarray) -> None:
        single = [w for w, x in zip(words, letters) if not x]
        plain = [w for w, x in zip(words, letters) if x]
        groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for at in range(0, len(groups), 64):
            some = groups[at : at + 64]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                last = np.flatnonzero(self.ends[ids]) + 1
                if len(last) == len(group) and last[-1] == len(ids):
                    self._add(group, ids, np.diff(np.concatenate(([0], last))))
                else:
                    single += group
        for at in range(0, len(single), 20_000):
            some = single[at : at + 20_000]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._add(some, np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64))

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Numbers of the words among the known ones; new ones are learned."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        names = distinct.to_pylist()
        rows = np.fromiter((self.known.get(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(rows < 0)
        if len(new):
            letters = pc.match_substring_regex(distinct.take(pa.array(new)), r"^\pL+$").to_numpy(zero_copy_only=False)
            self._learn([names[i] for i in new], letters)
            rows[new] = [self.known[names[i]] for i in new]
        return rows[coded.indices.to_numpy()] if len(coded) else rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the bounds of each text's ids."""
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = words.flatten().dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        if len(self.known) + 2 * len(distinct) > self.remember:
            self.forget()
        special = pc.match_substring(distinct, "<|")
        lower = pc.if_else(special, distinct, pc.ascii_lower(distinct))
        core = pc.utf8_rtrim(lower, characters=self.STOPS)
        cut = pc.and_(pc.not_equal(pc.binary_length(core), pc.binary_length(lower)), pc.match_substring_regex(core, "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]$"))
        cut = pc.and_(cut, pc.invert(special))
        core = pc.if_else(cut, core, lower)
        rest = np.zeros(len(distinct), np.int64)
        with_rest = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        if len(with_rest):
            tails = pc.replace_substring_regex(lower.take(pa.array(with_rest)), r"^.*?([.,;:!?]*)$", r"\1")
            rest[with_rest] = self._rows(tails)
        rows = np.stack([self._rows(core), rest], axis=1)[codes].ravel() if len(codes) else np.zeros(0, np.int64)
        n = self.size[rows]
        edges = np.concatenate(([0], np.cumsum(n)))
        take = np.repeat(self.first[rows] - edges[:-1], n)
        take += np.arange(edges[-1])
        return self.flat[take], edges[2 * bounds]


def _encoder(path: str, remember: int) -> WordEncoder:
    if getattr(_LOCAL, "made", None) != (path, remember):
        _LOCAL.made, _LOCAL.encoder = (path, remember), WordEncoder(path, remember)
    return _LOCAL.encoder


# --------------------------------------------------------------------------- index


def _key_hash(doc: np.ndarray, occurrence: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = np.uint64((level * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % 2**64)
        return mix(doc.astype(np.int64).view(np.uint64) ^ mix(occurrence.astype(np.int64).view(np.uint64) + seed))


def build_part(doc: np.ndarray, occurrence: np.ndarray, shard: np.ndarray, offset: np.ndarray, count: np.ndarray) -> bytes:
    """One index part. Level by level each key left hashes into a bit array; bits hit by
    one key stay and name it, the others go on to the next level. A key's number is the
    count of bits before its own over all levels."""
    levels, number = [], np.empty(len(doc), np.int64)
    left, before = np.arange(len(doc)), 0
    while len(left):
        size = max(64, int(GAMMA * len(left) + 63) // 64 * 64)
        at = (_key_hash(doc[left], occurrence[left], len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        settled = bits[at]
        number[left[settled]] = before + (np.cumsum(bits) - 1)[at[settled]]
        before += int(bits.sum())
        levels.append(np.packbits(bits, bitorder="little"))
        left = left[~settled]
    entries = np.zeros(len(doc), [("finger", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("count", "<u4")])
    entries["finger"][number] = (_key_hash(doc, occurrence, 255) >> np.uint64(32)).astype(np.uint32)
    entries["shard"][number], entries["offset"][number], entries["count"][number] = shard, offset, count
    head = struct.pack("<8sIQ", MAGIC, len(levels), len(doc)) + b"".join(struct.pack("<Q", len(x)) for x in levels)
    return head + b"".join(x.tobytes() for x in levels) + entries.tobytes()


class IndexPart:
    """Constant-time lookup in one part."""

    def __init__(self, data: bytes):
        magic, n_levels, self.n = struct.unpack_from("<8sIQ", data)
        if magic != MAGIC:
            raise ValueError("not an index part")
        sizes = struct.unpack_from(f"<{n_levels}Q", data, 20)
        at, self.levels, self.ranks, before = 20 + 8 * n_levels, [], [], 0
        for size in sizes:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little").astype(bool)
            self.levels.append(bits)
            self.ranks.append(before + np.cumsum(bits) - 1)
            before, at = before + int(bits.sum()), at + size
        self.entries = np.frombuffer(data, [("finger", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("count", "<u4")], self.n, at)

    def find(self, doc: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 for keys that the part doesn't hold (but for one in 2**32)."""
        found = np.full(len(doc), -1, np.int64)
        left = np.arange(len(doc))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (_key_hash(doc[left], occurrence[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            found[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        finger = (_key_hash(doc, occurrence, 255) >> np.uint64(32)).astype(np.uint32)
        held = found >= 0
        held[held] = self.entries["finger"][found[held]] == finger[held]
        return np.where(held, found, -1)


def _part_of(doc: np.ndarray, occurrence: np.ndarray, parts: int) -> np.ndarray:
    return (_key_hash(doc, occurrence, 254) % np.uint64(parts)).astype(np.int64)


# --------------------------------------------------------------------------- writing


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, order: list | None = None, vocabulary: int = 49408, slice_bytes: int = 16 << 20, remember: int = 500_000) -> str:
    """Encode every text, append ``end_id``, and write the store in the order of ``doc_id``
    (or of the columns ``order``). Returns the store's path.

    Null texts are empty, null ids come first, repeated ids follow each other (by text), other
    columns are ignored, an empty table gives a store without shards. One exchange deals the
    texts to ranges of the order; a range is a shard. ``tokenizer`` is a file that each
    executor can open. Its words must not span ASCII white space. ``slice_bytes`` of text and
    ``remember`` words trade a worker's memory for speed; the ids don't depend on them.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or new_path(spark, "tokens")
    width = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(order or [])), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keys = [f"_k{i}" for i in range(len(order or []))]
    dealt = rows.repartitionByRange(*keys, "doc_id", F.xxhash64("text")).sortWithinPartitions(*keys, "doc_id", "text")

    def encode(batches):
        shard, written, run_id, run = TaskContext.get().partitionId(), 0, None, -1
        fs, folder = _open(path)
        fs.create_dir(folder, recursive=True)
        name = f"ids-{shard:05d}.bin"
        hidden = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
        encoder = _encoder(tokenizer, remember)
        with fs.open_output_stream(hidden, compression=None) as out:
            for batch in batches:
                for at, to in byte_slices(batch.column("text"), slice_bytes):
                    some = batch.slice(at, to - at)
                    ids, bounds = encoder.encode(some.column("text"))
                    n = np.diff(bounds)
                    payload = np.insert(ids, bounds[1:], end_id).astype(width)
                    out.write(payload.tobytes())
                    doc, runs = some.column("doc_id").to_pylist(), []
                    for d in doc:
                        run = run + 1 if runs_on(d, run_id, run) else 0
                        run_id = d
                        runs.append(run)
                    starts = written + bounds[:-1] + np.arange(len(n))
                    written += len(payload)
                    yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), pa.array(runs, pa.int64()), pa.array(np.full(len(n), shard), pa.int32()), pa.array(starts, pa.int64()), pa.array(n + 1, pa.int64())], names=["doc_id", "run", "shard", "offset", "n"])
        _place(fs, hidden, f"{folder}/{name}")
        if remember < 200_000:
            encoder.forget()

    def runs_on(d, before, run):
        return run >= 0 and d == before

    slots = materialize(dealt.select("doc_id", "text").mapInArrow(trimmed(encode), "doc_id long, run long, shard int, offset long, n long"), "token-slots")
    # one row a shard: its ids, and the runs of equal keys at its edges
    edges = sorted(slots.groupBy("shard").agg(F.sum("n"), F.count("*"), F.min(F.struct("offset", "doc_id")), F.max(F.struct("offset", "doc_id", "run"))).collect())
    base, carried, starts, sizes, total, last, first_of = 0, 0, {}, {}, 0, None, []
    for shard, n, rows_here, low, high in edges:
        first = low["doc_id"]
        before = carried if last is not None and last[0] == first else 0
        starts[shard], sizes[shard] = base, n
        first_of.append((shard, first, before))
        same = high["doc_id"] == first
        carried = high["run"] + 1 + (before if same else 0)
        last = (high["doc_id"],)
        base, total = base + n, total + rows_here
    parts = max(1, -(-total // KEYS_A_PART))
    carry = spark.createDataFrame(first_of or [(0, None, 0)], "shard int, _first long, _before long")
    keyed = slots.join(F.broadcast(carry), "shard").withColumn(  # one row a shard
        "run", F.col("run") + F.when(F.col("doc_id").eqNullSafe(F.col("_first")), F.col("_before")).otherwise(F.lit(0))
    )

    def key_parts(batches):
        for b in batches:
            doc, occ = _keys(b.column("doc_id"), b.column("run"))
            yield pa.RecordBatch.from_arrays([pa.array(_part_of(doc, occ, parts)), pa.array(doc), pa.array(occ), b.column("shard"), b.column("offset"), b.column("n")], names=["part", "doc", "occ", "shard", "offset", "n"])

    def index(table):
        part = table.column("part")[0].as_py()
        cols = [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("doc", "occ", "shard", "offset", "n")]
        data = build_part(*cols)
        _write(path, f"index-{part:05d}.mph", data)
        return pa.table({"part": pa.array([part], pa.int64()), "keys": pa.array([len(cols[0])], pa.int64())})

    parted = keyed.select("doc_id", "run", "shard", "offset", "n").mapInArrow(key_parts, "part long, doc long, occ long, shard int, offset long, n long")
    built = parted.groupBy("part").applyInArrow(index, "part long, keys long").agg(F.sum("keys")).first()[0] or 0
    if built != total:
        raise RuntimeError(f"the index holds {built} of {total} keys")
    drop_table(slots)
    _write(path, "manifest.json", json.dumps({"width": np.dtype(width).itemsize, "parts": parts, "documents": total, "starts": starts, "sizes": sizes, "end_id": end_id}).encode())
    return path


def _keys(doc_id: pa.Array, run: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    missing = pc.is_null(doc_id).to_numpy(zero_copy_only=False)
    runs = run.to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False).astype(np.int64), np.where(missing, -1 - runs, runs)


# --------------------------------------------------------------------------- reading


class TokenStore:
    """Keyed access to a store without Spark."""

    def __init__(self, path: str):
        self.path = path
        self.manifest = json.loads(_read(path, "manifest.json"))
        self.parts: dict[int, IndexPart] = {}

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document with the end id, or None."""
        doc = np.array([doc_id or 0], np.int64)
        occ = np.array([-1 - occurrence if doc_id is None else occurrence], np.int64)
        part = int(_part_of(doc, occ, self.manifest["parts"])[0])
        if not self.manifest["documents"]:
            return None
        if part not in self.parts:
            try:
                self.parts[part] = IndexPart(_read(self.path, f"index-{part:05d}.mph"))
            except FileNotFoundError:
                return None
        at = int(self.parts[part].find(doc, occ)[0])
        if at < 0:
            return None
        e, width = self.parts[part].entries[at], self.manifest["width"]
        fs, folder = _open(self.path)
        with fs.open_input_file(f"{folder}/ids-{int(e['shard']):05d}.bin") as f:
            f.seek(int(e["offset"]) * width)
            return np.frombuffer(f.read(int(e["count"]) * width), f"<u{width}")


def read_store(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from the store's files, for each row of ``keys``
    (column doc_id; the n-th row of an id is its n-th occurrence).

    Keys are dealt to index parts, the found places to shards; each task reads one part or
    the ranges of one stretch of a shard in ascending order. Keys that the store doesn't hold give no row.
    """
    manifest = json.loads(_read(path, "manifest.json"))
    parts, width = manifest["parts"], manifest["width"]
    starts = {int(k): v for k, v in manifest["starts"].items()}
    counted = keys.groupBy("doc_id").agg(F.count("*").alias("c"))
    each = counted.select("doc_id", F.explode(F.expr("sequence(0l, c - 1)")).alias("run"))

    def deal(batches):
        for b in batches:
            doc, occ = _keys(b.column("doc_id"), b.column("run"))
            yield pa.RecordBatch.from_arrays([pa.array(_part_of(doc, occ, parts)), pa.array(doc), pa.array(occ)], names=["part", "doc", "occ"])

    def look_up(table):
        doc, occ = (table.column(c).combine_chunks().to_numpy() for c in ("doc", "occ"))
        try:
            part = IndexPart(_read(path, f"index-{table.column('part')[0].as_py():05d}.mph"))
            at = part.find(doc, occ)
        except FileNotFoundError:
            at = np.full(len(doc), -1)
        ok = at >= 0
        e = part.entries[at[ok]] if ok.any() else np.zeros(0, [("shard", "<u4"), ("offset", "<u8"), ("count", "<u4")])
        missing = pa.array(occ[ok] < 0)
        ids = pc.if_else(missing, pa.scalar(None, pa.int64()), pa.array(doc[ok]))
        return pa.table([ids, pa.array(e["shard"].astype(np.int32)), pa.array(e["offset"].astype(np.int64)), pa.array(e["count"].astype(np.int64))], names=["doc_id", "shard", "offset", "n"])

    def checksums(table):
        shard = table.column("shard")[0].as_py()
        table = table.sort_by("offset")
        offset, n = (table.column(c).combine_chunks().to_numpy() for c in ("offset", "n"))
        fs, folder = _open(path)
        crc = np.zeros(len(n), np.int64)
        with fs.open_input_file(f"{folder}/ids-{shard:05d}.bin") as f:
            for i in range(len(n)):
                f.seek(int(offset[i]) * width)
                ids = np.frombuffer(f.read(int(n[i]) * width), f"<u{width}")
                if len(ids) != n[i]:
                    raise IOError(f"shard {shard} ends early")
                crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
        return pa.table([table.column("doc_id").combine_chunks(), pa.array(offset + starts[shard]), pa.array(n), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    found = each.mapInArrow(deal, "part long, doc long, occ long").groupBy("part").applyInArrow(look_up, "doc_id long, shard int, offset long, n long")
    stretch = F.shiftright("offset", STRETCH_BITS).alias("stretch")
    return found.groupBy("shard", stretch).applyInArrow(checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
