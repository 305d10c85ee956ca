"""Token ids: encoding, a binary shard format and its minimal perfect hash index.

Format. ``shards/P-K.ids``: 16 bytes of header (``TWID``, version, bytes an id, ids), then raw little-endian ids, the
documents one after another in ascending key order. ``index/B.mph``: for the keys whose hash falls in bucket B the bit
levels of a minimal perfect hash, and for each slot the key's fingerprint, shard, offset, length and global start.
A keyed read takes one bucket, one slot and one range of one shard, whatever the size of the corpus.
"""
from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm._shared import U, mix, ragged, read_file, run_hashes, settle, slices, work_dir, write_file

END_ID = 2
_CACHE = 2_000_000
_CHUNK = 1 << 21
_LETTER, _NUMBER, _SPACE, _OTHER, _EDGE, _UNSURE = range(6)


def _classes() -> np.ndarray:
    """Class of each code point (letter, number, white space, other); one more entry is the edge of a text. What the Unicode
    tables at hand do not know is unsure: the library may have newer ones."""
    import unicodedata

    kinds = {"L": _LETTER, "N": _NUMBER}
    names = (unicodedata.category(chr(c)) for c in range(0x110000))
    out = np.fromiter((_UNSURE if n == "Cn" else kinds.get(n[0], _OTHER) for n in names), np.int8, 0x110000)
    space = [c for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    out[space] = _SPACE
    return np.append(out, np.int8(_EDGE))


class Encoder:
    """The ids of a byte-level BPE.

    Merges never cross the vocabulary's split points, so a text's ids are those of its pieces one after another. Pieces
    are found for many texts at once; each new one is encoded by the tokenizers library and kept under its 64-bit hash
    (a bounded number is kept).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.classes = Tokenizer.from_file(path), _classes()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.starts, self.lengths = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def pieces(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of texts, each followed by an edge: runs of one class with up to one blank before;
        contractions; white space, without its last character if text follows."""
        kind = self.classes[points]
        start = np.flatnonzero(np.diff(kind, prepend=np.int8(9)))
        end, kind = np.append(start[1:], len(points)), kind[start]
        following = np.append(kind[1:], _EDGE)
        # the last of a white-space run goes to what follows (a blank) or stands alone
        split = (kind == _SPACE) & (following != _EDGE)
        blank = split & (points[end - 1] == 32)
        joined = np.append(False, blank[:-1])
        start = start - joined
        end = end - split
        # an apostrophe that begins a piece takes the letters of a contraction from the run behind it
        quote = np.flatnonzero((kind == _OTHER) & ~joined & (end - start == 1) & (points[start] == 39) & (following == _LETTER))
        if len(quote):
            p = np.append(points, [0x110000] * 2)
            at = start[quote] + 1
            one = np.isin(p[at], [ord(c) for c in "stmd"])
            two = ~one & (((p[at] == ord("r")) | (p[at] == ord("v"))) & (p[at + 1] == ord("e")) | (p[at] == ord("l")) & (p[at + 1] == ord("l")))
            taken = one + 2 * two
            end[quote] += taken
            start[quote + 1] += taken
        lone = np.flatnonzero(split & ~blank)
        keep = (end > start) & (kind != _EDGE)
        starts, ends = np.concatenate([start[keep], end[lone]]), np.concatenate([end[keep], end[lone] + 1])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        got = [e.ids for e in encode(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        if self.used + int(n.sum()) > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), self.used + int(n.sum())))
        self.ids[self.used:self.used + int(n.sum())] = np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum()))
        at = np.searchsorted(self.keys, keys)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(n) - n)
        self.lengths, self.keys = np.insert(self.lengths, at, n), np.insert(self.keys, at, keys)
        self.used += int(n.sum())

    def encode(self, texts: list[str | None], end_id: int = END_ID) -> Iterator[np.ndarray]:
        """The ids of each text with the end id, in order."""
        import pandas as pd

        for a, b in slices(texts, _CHUNK):
            part = [t or "" for t in texts[a:b]]
            if len(self.keys) > _CACHE:
                self._clear()
            edge = np.array([0x110000], dtype=np.uint32)
            points = np.concatenate([x for t in part for x in (np.frombuffer(t.encode("utf-32-le"), np.uint32), edge)])
            kind = self.classes[points]
            edges = np.append(0, np.flatnonzero(points == 0x110000))
            unsure = np.diff(np.append(0, np.cumsum(kind == _UNSURE))[edges + np.append(0, np.ones(len(edges) - 1, np.int64))]) > 0
            s, e = self.pieces(points)
            codes, unique, first = _distinct(pd, run_hashes(points, s, e))
            order = np.argsort(unique)
            at = np.searchsorted(self.keys, unique[order])
            new = order[(self.keys[np.minimum(at, len(self.keys) - 1)] != unique[order]) | (at == len(self.keys))] if len(self.keys) else order
            if len(new):
                raw = points.tobytes()
                self._learn(unique[new], [raw[4 * s[i]:4 * e[i]].decode("utf-32-le") for i in first[new].tolist()])
            slot = np.searchsorted(self.keys, unique)[codes]
            n = self.lengths[slot]
            flat = self.ids[ragged(self.starts[slot], n)]
            stop = np.append(0, np.cumsum(n))[np.searchsorted(s, edges)]
            for t, lo, hi, whole in zip(part, stop[:-1].tolist(), stop[1:].tolist(), unsure.tolist(), strict=True):
                if whole or any(x in t for x in self.special):  # special strings have ids of their own
                    yield np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, end_id], dtype=np.uint32)
                    continue
                out = np.empty(hi - lo + 1, dtype=np.uint32)
                out[:-1], out[-1] = flat[lo:hi], end_id
                yield out


def _distinct(pd, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each hash, the different hashes, and where each came first."""
    codes, unique = pd.factorize(hashes)
    first = np.zeros(len(unique), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(hashes))[::-1]
    return codes, unique, first


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and path."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


# --- minimal perfect hash -------------------------------------------------------------------------------------------

_GAMMA = 2.0


class PerfectHash:
    """Maps n different 128-bit keys to 0..n-1. Level i is a bit array; a key stays at the first level where it is alone
    on its bit, and its slot is the number of bits set before."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.before, total = levels, [], 0
        for bits in levels:
            counts = np.cumsum(bits, dtype=np.int64)
            self.before.append(counts - bits + total)
            total += int(counts[-1]) if len(bits) else 0
        self.n = total

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a ^ mix(b + U(level * 2 + 1))) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(a):
            if len(levels) > 200:
                raise ValueError("equal keys have no perfect hash")
            at = cls._place(a, b, len(levels), size := max(64, int(len(a) * _GAMMA)))
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            stay = ~alone[at]
            a, b = a[stay], b[stay]
        return cls(levels)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that were not in the set (the others need the fingerprint)."""
        out, left = np.full(len(a), -1, dtype=np.int64), np.arange(len(a))
        for i, bits in enumerate(self.levels):
            at = self._place(a[left], b[left], i, len(bits))
            hit = bits[at]
            out[left[hit]] = self.before[i][at[hit]]
            left = left[~hit]
        return out

    def pack(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(x)) + np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, raw: bytes) -> tuple[PerfectHash, int]:
        (n,), at, levels = struct.unpack_from("<I", raw), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", raw, at)
            m = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, m, at + 8), count=size).astype(bool))
            at += 8 + m
        return cls(levels), at


#: The layout of an index slot and of the shard header.
_SLOT = np.dtype([("print", "<u4"), ("part", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8"), ("start", "<u8")])
_HEADER = "<4sHHQ"
_KEYS_A_BUCKET = 200_000
_SHARD_IDS = 1 << 22


def _shard_path(root: str, part: int, shard: int) -> str:
    return f"{root}/shards/{part:06d}-{shard:04d}.ids"


def write_tokens(docs: DataFrame, root: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes shards and index under ``root``; gives the written keys (``key``, ``_occ``).

    Documents go in ascending key order (null keys first, equal keys by text); ``_occ`` counts the rows of one key, so
    repeated keys stay apart. Null text is empty and holds just the end id. Other columns are left alone. An empty table
    writes no file. A shard closes at 4M ids; a longer document fills a shard of its own.
    """
    spark = docs.sparkSession
    width = 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    base = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    ordered = base.repartitionByRange("_key").sortWithinPartitions("_key", "_text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, rows, offset, last, occ = [], [], 0, object(), 0

        def close() -> pa.RecordBatch:
            nonlocal held, rows, offset, shard
            write_file(_shard_path(root, part, shard), [struct.pack(_HEADER, b"TWID", 1, width, offset), *held])
            k, o, at, n = zip(*rows, strict=True)
            out = pa.record_batch([pa.array(k, kind), pa.array(o, pa.int32()), pa.array([part] * len(k), pa.int32()), pa.array([shard] * len(k), pa.int32()),
                                   pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["_key", "_occ", "part", "shard", "offset", "n"])
            held, rows, offset, shard = [], [], 0, shard + 1
            return out

        for batch in batches:
            kind = batch.column(0).type
            for a, b in slices(batch.column(1).to_pylist()):
                chunk = batch.slice(a, b - a)
                for k, ids in zip(chunk.column(0).to_pylist(), enc.encode(chunk.column(1).to_pylist(), end_id), strict=True):
                    occ, last = (occ + 1 if k == last else 0), k
                    if rows and offset + len(ids) > _SHARD_IDS:
                        yield close()
                    rows.append((k, occ, offset, len(ids)))
                    held.append(ids.astype(f"<u{width}").tobytes())
                    offset += len(ids)
        if rows:
            yield close()

    kind = base.schema["_key"].dataType.simpleString()
    listed = settle(ordered.mapInArrow(shards, f"_key {kind}, _occ int, part int, shard int, offset long, n long"), f"{root}/listed")
    # starts: a running sum over shards (one row for each few million ids), not over documents
    sums = listed.groupBy("part", "shard").agg(F.sum("n").alias("_n"))
    before = sums.select("part", "shard", (F.sum("_n").over(Window.orderBy("part", "shard")) - F.col("_n")).alias("_before"))
    buckets = max(1, math.ceil(listed.count() / _KEYS_A_BUCKET))
    entries = (listed.join(before, ["part", "shard"]).select(*_hashes("_key", "_occ", buckets), "part", "shard", "offset", "n",
                                                             (F.col("_before") + F.col("offset")).alias("start")))

    def index(table: pa.Table) -> pa.Table:
        c = {n: table.column(n).to_numpy() for n in table.column_names}
        a, b = c["_a"].view(U), c["_b"].view(U)
        mph = PerfectHash.build(a, b)
        at = mph.slots(a, b)
        slots = np.zeros(len(a), dtype=_SLOT)
        slots["print"][at] = (mix(b) >> U(32)).astype(np.uint32)
        for name in ("part", "shard", "offset", "n", "start"):
            slots[name][at] = c[name]
        bucket = int(c["_bucket"][0])
        write_file(f"{root}/index/{bucket:08d}.mph", [mph.pack(), slots.tobytes()])
        return pa.table({"bucket": [bucket], "keys": [len(a)]})

    settle(entries.groupBy("_bucket").applyInArrow(index, "bucket long, keys long"), f"{root}/built")
    return listed.select(F.col("_key").alias(key), "_occ").withColumn("_buckets", F.lit(buckets))


def _hashes(key: str, occ: str, buckets):
    h = lambda salt: F.xxhash64(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull(), F.col(occ))
    return h(1).alias("_a"), h(2).alias("_b"), F.pmod(h(3), F.lit(buckets)).alias("_bucket")


def read_tokens(keys: DataFrame, root: str, key: str = "doc_id") -> DataFrame:
    """Keyed reads: (key, _occ, _buckets) to ``start``, ``n_tokens`` and ``ids_crc32`` out of the files.

    A key that is not in the files gives no row (its fingerprint differs, but for one in 2^32).
    """
    kind = keys.schema[key].dataType.simpleString()
    buckets = keys.select("_buckets").first()
    if buckets is None:
        return keys.select(F.col(key), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("ids_crc32"))
    asked = keys.select(F.col(key).alias("_key"), *_hashes(key, "_occ", buckets[0]))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, mph, slots = None, None, None
        for batch in batches:
            bucket = batch.column("_bucket").to_numpy()
            a, b = (batch.column(n).to_numpy().view(U) for n in ("_a", "_b"))
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if opened != bucket[lo]:
                    opened = bucket[lo]
                    raw = read_file(f"{root}/index/{opened:08d}.mph")
                    mph, at = PerfectHash.unpack(raw)
                    slots = np.frombuffer(raw, _SLOT, offset=at)
                s = mph.slots(a[lo:hi], b[lo:hi])
                ok = s >= 0
                ok[ok] = slots["print"][s[ok]] == (mix(b[lo:hi][ok]) >> U(32)).astype(np.uint32)
                hit, names = slots[s[ok]], ("part", "shard", "offset", "n", "start")
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).filter(pa.array(ok)), *(pa.array(hit[n].astype(np.int64)) for n in names)], names=["_key", *names])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, payload, width = None, None, 0
        for batch in batches:
            part, shard, offset, n = (batch.column(c).to_numpy() for c in ("part", "shard", "offset", "n"))
            crc = np.zeros(len(n), dtype=np.int64)
            for i in range(len(n)):
                if opened != (part[i], shard[i]):
                    opened = (part[i], shard[i])
                    raw = read_file(_shard_path(root, *map(int, opened)))
                    _, _, width, _ = struct.unpack_from(_HEADER, raw)
                    payload = np.frombuffer(raw, f"<u{width}", offset=struct.calcsize(_HEADER))
                crc[i] = crc32_ids(payload[offset[i]:offset[i] + n[i]])
            yield pa.record_batch([batch.column("_key"), batch.column("start"), batch.column("n"), pa.array(crc)], names=[key, "start", "n_tokens", "ids_crc32"])

    placed = (asked.repartition("_bucket").sortWithinPartitions("_bucket")
              .mapInArrow(locate, f"_key {kind}, part long, shard long, offset long, n long, start long"))
    return (placed.repartition("part", "shard").sortWithinPartitions("part", "shard", "offset")
            .mapInArrow(fetch, f"{key} {kind}, start long, n_tokens long, ids_crc32 long"))


def token_files(docs: DataFrame, tokenizer: str, root: str | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) and reads every document back by key."""
    root = root or work_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, root, tokenizer), root)
