"""Best-fit packing of documents into sequences."""
from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm._shared import settle, slices, work_dir
from tracewright.llm.tokens import END_ID, crc32_ids, encoder

_PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, _part int, _local long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = END_ID) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids; only longer ones are cut, and their first piece is the short one.

    ``_local`` numbers the pieces of one length within the task ``_part``. The frame must be written before use: the
    numbers belong to that one run.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for a, b in slices(batch.column(1).to_pylist()):
                chunk, rows = batch.slice(a, b - a), []
                for i, ids in enumerate(enc.encode(chunk.column(1).to_pylist(), end_id)):
                    at, n = 0, len(ids) % capacity or capacity
                    for piece in range(-(-len(ids) // capacity)):
                        rows.append((i, piece, at, n, crc32_ids(ids[at:at + n]), seen[n]))
                        seen[n] += 1
                        at, n = at + n, capacity
                i, piece, at, n, crc, local = map(np.array, zip(*rows, strict=True))
                yield pa.record_batch([chunk.column(0).take(pa.array(i)), pa.array(piece, pa.int32()), pa.array(at), pa.array(n), pa.array(crc, pa.int64()),
                                       pa.array(np.full(len(i), part), pa.int32()), pa.array(local)], names=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_local"])

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES.format(kind=kind))


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit over sizes in descending order, all pieces of a size at once.

    Pieces and gaps are sorted runs of equal sizes. In each round the largest size left meets its successor, the smallest
    gap that holds it; piece rank r takes gap rank r (so no two claim one gap), the gaps shrink, and the round is repeated
    until the size is placed. Returns (length, first rank, n, first sequence, offset) and the number of sequences. What it
    holds depends on the capacity, not on the number of documents.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # gap sizes in use, ascending
    plan, sequences = [], 0

    def free(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                bisect.insort(sizes, size)
            gaps.setdefault(size, []).append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):
                break
            size = sizes[k]
            first, n = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], sizes[k]
            take = min(n, left)
            plan.append((length, rank, take, first, capacity - size))
            free(size - length, first, take)
            free(size, first + take, n - take)
            rank, left = rank + take, left - take
        fit = capacity // length
        for bins, layers in ((left // fit, fit), (1, left % fit)):  # new sequences: full ones, then one with the rest
            if bins and layers:
                for layer in range(layers):
                    plan.append((length, rank, bins, sequences, layer * length))
                    rank += bins
                free(capacity - layers * length, sequences, bins)
                sequences += bins
    return plan, sequences


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset`` there.

    Null and empty texts are one piece of the end id. Repeated rows are packed each; an empty table gives no rows; other
    columns are left alone. Ties in size go by task and order in the task.
    """
    spark = docs.sparkSession
    root = work_dir(spark, "packing")
    pieces = settle(cut_pieces(docs, tokenizer, capacity, end_id), f"{root}/pieces")
    runs = settle(pieces.groupBy("_part", "length").agg(F.count("*").alias("_n")), f"{root}/runs")
    counts = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = best_fit(counts, capacity)
    plan.sort()
    table = np.array(plan, dtype=np.int64).reshape(-1, 5)
    span = max(counts.values(), default=0) + 1
    keys = table[:, 0] * span + table[:, 1]
    before = runs.select("_part", "length", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = pieces.join(before, ["_part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_local")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = table[np.searchsorted(keys, length * span + rank, side="right") - 1]
            yield pa.record_batch([*batch.columns[:5], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
