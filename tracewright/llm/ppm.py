"""Language-model scoring: prediction by partial matching over bytes, and a smoothed unigram base.

The model is a trie of byte contexts up to ORDER, counted over the training documents. A symbol unseen in a context
escapes to the next shorter one (method C: as many escapes as different symbols), where the symbols of the longer context
are excluded. What a longer context excludes depends on that context alone, so its sums stand beside it and a byte costs
one lookup if its window was seen, one for each order else. A text ends with a zero byte and begins after ORDER of them.

No task holds the trie. Each different window that occurs anywhere is scored once, in groups by the last two bytes of its
context: all contexts of two bytes and more are whole there, and of shorter ones there are 65536 counts in all. A part of the
documents gets the scores of its own windows, as it gets the counts of its own words, so documents are read twice at any size.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._shared import SPACED, U, byte_words, in_fold, read_file, settle, slices, work_dir, write_file

ORDER = 4
#: Documents that share a file of word counts and window scores.
PART_ROWS = 1 << 13
_CHUNK = 1 << 22


def _lowered(texts: list[str | None]) -> list[bytes]:
    """UTF-8 with A-Z in lower case."""
    return [(t or "").encode().lower() for t in texts]


def windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, codes): for every byte of a text and its end the ORDER bytes before and itself, as one integer."""
    pad = b"\0" * ORDER
    data = np.frombuffer(b"".join(x for r in raw for x in (pad, r, b"\0")), np.uint8).astype(U)
    code = np.zeros(len(data), U)
    for j in range(ORDER + 1):
        code[ORDER:] |= data[ORDER - j:len(data) - j] << U(8 * j)
    n = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    at = np.append(0, np.cumsum(n))
    own = np.ones(len(data), bool)
    first = at[:-1] + ORDER * np.arange(len(raw))
    for j in range(ORDER):
        own[first + j] = False
    return at, code[own]


def words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the words."""
    at = np.append(0, np.cumsum([len(r) + 1 for r in raw]))
    s, _, h = byte_words(np.frombuffer(b"\n".join(raw), np.uint8), SPACED)
    return np.searchsorted(s, at), h


def _tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    import pandas as pd

    codes, unique = pd.factorize(keys)
    return unique, np.bincount(codes, weights=weights, minlength=len(unique)).astype(np.int64)


class Trie:
    """Log10 probabilities by window. ``codes`` and ``counts`` are the training windows, of full length, of contexts that end in
    the same two bytes; longer contexts are their sums. ``pairs`` counts the bytes (columns) that follow each byte (rows)."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, last: int, pairs: np.ndarray):
        self.tables = []
        for k in range(ORDER, 1, -1):
            g, inverse = np.unique(codes & U((1 << 8 * (k + 1)) - 1), return_inverse=True)
            c = np.bincount(inverse, weights=counts, minlength=len(g))
            ctx, first = np.unique(g >> U(8), return_index=True)
            n = np.add.reduceat(c, first) if len(g) else c
            self.tables.append([g, c, ctx, n, np.diff(np.append(first, len(g))).astype(float), None])
        for c, ctx in ((pairs[last], last), (pairs.sum(axis=0), 0)):
            seen = np.flatnonzero(c)
            some = min(1, len(seen))
            self.tables.append([seen.astype(U) | U(ctx << 8), c[seen], np.full(some, ctx, U), np.full(some, c.sum()), np.full(some, float(len(seen))), None])
        for k in range(ORDER):  # what a context excludes in the next shorter one: the counts of its symbols there
            g, _, ctx, *_ = self.tables[k]
            short, c = self.tables[k + 1][:2]
            first = np.searchsorted(g >> U(8), ctx)
            if len(g):
                mask = U((1 << 8 * (ORDER - k)) - 1)
                self.tables[k][5] = np.add.reduceat(c[np.searchsorted(short, g & mask)], first)

    def score(self, codes: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        gone_n, gone_q = np.zeros(len(codes)), np.zeros(len(codes))  # counts and symbols excluded so far
        for depth, (g, c, ctx, n, q, drop) in enumerate(self.tables):
            if not len(left):
                return out
            mask = U((1 << 8 * (ORDER - depth + 1)) - 1)
            x = codes[left] & mask
            at = np.minimum(np.searchsorted(ctx, x >> U(8)), max(len(ctx) - 1, 0))
            there = ctx[at] == x >> U(8) if len(ctx) else np.zeros(len(x), bool)
            if not there.any():
                continue
            live, at, x = left[there], at[there], x[there]
            free_n, free_q = n[at] - gone_n[live], q[at] - gone_q[live]
            where = np.minimum(np.searchsorted(g, x), len(g) - 1)
            hit = g[where] == x
            done = live[hit]
            out[done] += np.log10(c[where[hit]] / (free_n[hit] + free_q[hit]))
            miss = ~hit
            some = miss & (free_q > 0)  # a context whose symbols are all excluded says nothing
            out[live[some]] += np.log10(free_q[some] / (free_n[some] + free_q[some]))
            if drop is not None:
                gone_n[live[miss]], gone_q[live[miss]] = drop[at[miss]], q[at[miss]]
            else:
                gone_q[live[miss]] = q[at[miss]]
            finished = np.zeros(len(codes), bool)
            finished[done] = True
            left = left[~finished[left]]
        out[left] -= np.log10(np.maximum(256 - gone_q[left], 1))
        return out


def score_documents(docs: DataFrame, modulus: int = 7, held_out: int = 2, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null is empty: one end token, and one end byte. Without training rows every count is 0 and every byte has 1/256.
    Repeated rows count and are scored each; other columns do not matter; an empty table gives no rows. Texts may be long.

    Counts cover all training documents: tasks send tallies, not tokens, so hot words and copies meet as partial sums.
    The documents of a part (``part_rows`` of an input split at most) get the counts of their own words and the scores of their
    own windows in one file, so neither vocabulary nor trie is ever held whole.
    """
    spark, root = docs.sparkSession, work_dir(docs.sparkSession, "ppm")
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = in_fold("doc_id", modulus, held_out) & F.col("doc_id").isNotNull()
    parts = settle(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held_out"), F.expr(f"monotonically_increasing_id() div {part_rows}").alias("part")), f"{root}/parts")

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallied: dict[tuple[int, int], list] = {}

        def rows(which: tuple[int, int], keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(keys), which[1], np.int8)), pa.array(keys.view(np.int64)), pa.array(n), pa.array(np.full(len(keys), which[0], np.int64))], names=["kind", "key", "n", "part"])

        def merged(pairs: list) -> tuple[np.ndarray, np.ndarray]:
            return _tally(np.concatenate([k for k, _ in pairs]), np.concatenate([n for _, n in pairs]))

        for batch in batches:
            texts, learn, part = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            for i, j in _runs(part):
                for done in [w for w in tallied if w[0] != part[i]]:
                    yield rows(done, *merged(tallied.pop(done)))
                for a, b in slices(texts[i:j], _CHUNK):
                    raw = _lowered(texts[i + a:i + b])
                    for kind, (at, keys) in enumerate((words(raw), windows(raw))):
                        held = tallied.setdefault(which := (int(part[i]), kind), [])
                        held.append(_tally(keys, np.repeat(~learn[i + a:i + b], np.diff(at)).astype(float)))
                        if sum(len(k) for k, _ in held) > 1_500_000:
                            held[:] = [merged(held)]
                            if len(held[0][0]) > 1_000_000:
                                yield rows(which, *tallied.pop(which)[0])
        for which, pairs in tallied.items():
            yield rows(which, *merged(pairs))

    counted = settle(parts.mapInArrow(tallies, "kind byte, key long, n long, part long"), f"{root}/tallies")
    total = counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    grams = settle(total.filter("kind = 1").select("key", "n"), f"{root}/windows")
    vocabulary = settle(total.filter("kind = 0 AND n > 0").select("key", "n"), f"{root}/words")
    ends = parts.filter("NOT held_out").count()
    v, n = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, different = n + ends, v + (ends > 0)
    pairs = np.zeros((256, 256))
    for r in grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("two")).agg(F.sum("n").alias("n")).collect():  # 65536 rows at most
        pairs[r["two"] >> 8, r["two"] & 255] = r["n"]
    shared = spark.sparkContext.broadcast(pairs)

    def scored(table: pa.Table) -> pa.Table:
        codes, counts = table.column("key").to_numpy().view(U), table.column("n").to_numpy()
        seen = counts > 0
        trie = Trie(codes[seen], counts[seen], int(codes[0] >> U(8)) & 255, shared.value)
        return pa.table({"key": table.column("key"), "value": trie.score(codes)})

    scores = grams.groupBy(F.shiftright("key", 8).bitwiseAND(0xFFFF)).applyInArrow(scored, "key long, value double")
    answers = vocabulary.select(F.lit(0).cast("byte").alias("kind"), "key", F.col("n").cast("double").alias("value")).unionByName(scores.select(F.lit(1).cast("byte").alias("kind"), "key", "value"))

    def keep(table: pa.Table) -> pa.Table:
        of, key, value = table.column("kind").to_numpy(), table.column("key").to_numpy().view(U), table.column("value").to_numpy()
        part, blobs = int(table.column("part")[0].as_py()), []
        for which in (0, 1):
            keys, first = np.unique(key[of == which], return_index=True)
            blobs += [np.uint64(len(keys)).tobytes(), keys.tobytes(), value[of == which][first].tobytes()]
        write_file(f"{root}/answers/{part:016x}.bin", blobs)
        return pa.table({"part": pa.array([part], pa.int64()), "keys": [len(key)]})

    asked = counted.select("kind", "key", "part").join(answers, ["kind", "key"])
    settle(asked.groupBy("part").applyInArrow(keep, "part long, keys long"), f"{root}/kept")
    base = math.log10(tokens + different + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None
        for batch in batches:
            texts, part = batch.column(1).to_pylist(), batch.column(3).to_numpy()
            for i, j in _runs(part):
                if opened != part[i]:  # a text has its end at least, so every part has a file
                    opened, data, at = part[i], read_file(f"{root}/answers/{int(part[i]):016x}.bin"), 0
                    tables = []
                    for _ in (0, 1):
                        m = int(np.frombuffer(data, U, 1, at)[0])
                        tables.append((np.frombuffer(data, U, m, at + 8), np.frombuffer(data, np.float64, m, at + 8 + 8 * m)))
                        at += 8 + 16 * m
                (known, counts), (seen, logs) = tables
                for a, b in slices(texts[i:j], _CHUNK):
                    raw = _lowered(texts[i + a:i + b])
                    at, g = windows(raw)
                    unique, code = _coded(g)
                    total = np.add.reduceat(logs[np.searchsorted(seen, unique)][code], at[:-1])
                    at, h = words(raw)
                    doc = np.repeat(np.arange(b - a), np.diff(at))
                    unique, code = _coded(h)
                    c = np.zeros(len(unique))
                    if len(known):
                        slot = np.minimum(np.searchsorted(known, unique), len(known) - 1)
                        c = np.where(known[slot] == unique, counts[slot], 0.0)
                    n_tokens = np.diff(at) + 1
                    n_known = np.bincount(doc, weights=(c > 0)[code], minlength=b - a).astype(np.int64) + (ends > 0)
                    gain = np.bincount(doc, weights=np.log10(c + 1.0)[code], minlength=b - a) + math.log10(ends + 1.0)
                    chunk = batch.slice(i + a, b - a)
                    yield pa.record_batch([chunk.column(0), chunk.column(2), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(b - a, tokens, np.int64)), pa.array(gain - n_tokens * base), pa.array(total)],
                                          names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return parts.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _runs(part: np.ndarray) -> list[tuple[int, int]]:
    """Neighbours of one part."""
    cut = (np.flatnonzero(part[1:] != part[:-1]) + 1).tolist()
    return list(zip([0, *cut], [*cut, len(part)], strict=True)) if len(part) else []


def _coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    import pandas as pd

    codes, unique = pd.factorize(keys)
    return unique, codes
