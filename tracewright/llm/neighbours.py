"""Exact nearest neighbours by a block matrix join over int8 tiles.

Rows are written once, as blocks of int8 codes with scales and error norms beside the vectors. A task holds one block of
queries, goes over row blocks one after another and keeps a heap of the best k for each query; the k-th best score so far and
the error bounds of the int8 product leave few pairs of a tile to score in double. No block is shuffled to meet another.
"""
from __future__ import annotations

import heapq
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm._shared import read_file, settle, work_dir, write_file

#: Rows of a block of queries and of a block of rows, and numbers in either at most (so wide vectors make smaller blocks).
QUERY_BLOCK, ROW_BLOCK, BLOCK_NUMBERS = 2048, 8192, 1 << 22
#: Components of one float32 product of codes: sums of products of two int8 codes stay under 2^24 and so are exact.
_SLAB = 1024


def _usable(v: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows as int8 codes, scales, norms of the rounded rows and of what rounding lost."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    code = np.rint(x / scale[:, None])
    back = code * scale[:, None]
    return code.astype(np.int8), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two int8 matrices, exact at any width."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], _SLAB):
        out += a[:, at:at + _SLAB].astype(np.float32) @ b[:, at:at + _SLAB].astype(np.float32).T
    return out


def pack_block(ids: np.ndarray, x: np.ndarray, k: int) -> bytes:
    """A block of rows as bytes. Of equal vectors only the k + 1 smallest ids can be among the best k of a query, so the
    others stay out."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    _, same = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).reshape(-1), return_inverse=True)
    by = np.argsort(same, kind="stable")
    keep = np.sort(by[np.arange(len(by)) - np.searchsorted(same[by], same[by]) <= k])
    ids, x = ids[keep], x[keep]
    code, scale, norm, lost = quantise(x)
    return struct.pack("<QQ", *x.shape) + b"".join(np.ascontiguousarray(v).tobytes() for v in (ids.astype(np.int64), scale, norm, lost, x, code))


def unpack_block(raw: bytes) -> tuple[np.ndarray, ...]:
    """(ids, scales, norms, lost, vectors, codes)."""
    n, d = struct.unpack_from("<QQ", raw)
    at, out = 16, []
    for kind, shape in ((np.int64, (n,)), (np.float64, (n,)), (np.float64, (n,)), (np.float64, (n,)), (np.float64, (n, d)), (np.int8, (n, d))):
        out.append(np.frombuffer(raw, kind, math.prod(shape), at).reshape(shape))
        at += out[-1].nbytes
    return tuple(out)


class Best:
    """The best k of each query of a block, over the tiles it has seen: a heap each, the worst on top."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.code, self.scale, self.norm, self.lost = quantise(x)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)  # the k-th best score so far

    def add(self, block: tuple[np.ndarray, ...]) -> None:
        """Meets a block of rows. The int8 product is off by at most |q'||c - c'| + |q - q'||c'| + |q - q'||c - c'| (primes:
        rounded); only pairs whose upper bound reaches both the k-th best score so far and the k-th best lower bound of the
        tile are scored in double. A row is not its own neighbour."""
        cid, scale, norm, lost, c, code = block
        for a in range(0, len(self.ids), 256):
            b = min(len(self.ids), a + 256)
            approx = products(self.code[a:b], code) * (self.scale[a:b, None] * scale[None, :])
            reach = self.norm[a:b, None] + self.lost[a:b, None]
            slack = (self.norm[a:b, None] * lost + self.lost[a:b, None] * (norm + lost)) * (1 + 1e-9) + 1e-9 * reach * (norm + lost)
            approx[self.ids[a:b, None] == cid[None, :]] = -np.inf
            low = self.least[a:b]
            if len(cid) > self.k:
                low = np.maximum(low, -np.partition(slack - approx, self.k - 1, axis=1)[:, self.k - 1])
            r, j = np.nonzero((approx + slack >= low[:, None]) & np.isfinite(approx))
            for at in range(0, len(r), 65536):
                rows, to = r[at:at + 65536], j[at:at + 65536]
                score = (self.x[a + rows] * c[to]).sum(axis=1)
                self._push(a, rows, cid[to], score)
            self.least[a:b] = [h[0][0] if len(h) == self.k else -np.inf for h in self.heaps[a:b]]

    def _push(self, a: int, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        for q, i, s in zip((a + rows).tolist(), ids.tolist(), score.tolist(), strict=True):
            heap = self.heaps[q]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                heapq.heapreplace(heap, (s, -i))

    def rows(self) -> pa.RecordBatch:
        found = [(q, -i, s) for q, heap in zip(self.ids.tolist(), self.heaps, strict=True) for s, i in heap]
        q, i, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.record_batch([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ids = table.column("id").to_numpy().astype(np.int64)
    return ids, flat.reshape(len(ids), -1)


def _blocked(df: DataFrame, size: int) -> tuple[DataFrame, dict[int, int]]:
    """Adds ``block``, and gives the number of blocks of each dimension (dimensions are few, the driver gets a row for each)."""
    sizes = {r["dim"]: r["n"] for r in df.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    blocks = {d: max(1, math.ceil(n / max(1, min(size, BLOCK_NUMBERS // d)))) for d, n in sizes.items()}
    count = F.create_map(*(F.lit(x) for kv in blocks.items() for x in kv)) if blocks else F.create_map(F.lit(0), F.lit(1))
    return df.withColumn("block", F.pmod(F.xxhash64("id"), count[F.col("dim")].cast("long")).cast("int")), blocks


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each query, in double precision.

    ``vectors`` and ``queries`` have vec_id and embedding, of any width. Vectors that are null or zero or hold null or
    non-finite components take no part, nor do null ids, nor pairs of different dimension. Ties go to the smaller vec_id.
    Rows of one vec_id are rows of their own among the neighbours; of queries with one vec_id the smallest vector is taken. Other columns do
    not matter; an empty side gives no rows.
    """
    spark, root = vectors.sparkSession, work_dir(vectors.sparkSession, "neighbours")
    clean = lambda df: df.filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("v"))
    rows, row_blocks = _blocked(clean(vectors), ROW_BLOCK)
    # of query rows with one id the one with the smallest vector asks
    single = clean(queries).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", "q.dim", "q.v")
    asked, query_blocks = _blocked(single, QUERY_BLOCK)

    def keep(table: pa.Table) -> pa.Table:
        ids, x = _matrix(table)
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        write_file(f"{root}/rows/{dim}-{block}.bin", [pack_block(ids, x, k)])
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32())})

    written = settle(rows.groupBy("dim", "block").applyInArrow(keep, "dim int, block int"), f"{root}/written")
    there: dict[int, list[int]] = {}
    for r in written.collect():  # a number for each few million components
        there.setdefault(r["dim"], []).append(r["block"])
    # the row blocks of a block of queries are dealt to several tasks if there are fewer blocks of queries than cores
    shares = max(1, math.ceil(spark.sparkContext.defaultParallelism / max(1, sum(query_blocks.values()))))
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def search(table: pa.Table) -> pa.Table:
        ids, x = _matrix(table)
        dim, share = table.column("dim")[0].as_py(), table.column("share")[0].as_py()
        best = Best(ids, x, k)
        for block in sorted(there.get(dim, []))[share::shares]:
            best.add(unpack_block(read_file(f"{root}/rows/{dim}-{block}.bin")))
        return pa.Table.from_batches([best.rows()])

    found = asked.groupBy("dim", "block", "share").applyInArrow(search, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []

        def ranked() -> list[tuple[int, int, int, float]]:
            return [(now, n + 1, -i, s) for n, (s, i) in enumerate(sorted(heap, reverse=True))]

        for batch in batches:
            out = []
            for q, i, s in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if q != now:
                    out += ranked()
                    now, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i))
                else:
                    heapq.heappushpop(heap, (s, -i))
            if out:
                yield lists(out)
        if heap:
            yield lists(ranked())

    def lists(out: list) -> pa.RecordBatch:
        q, rank, i, s = zip(*out, strict=True)
        return pa.record_batch([pa.array(q, pa.int64()), pa.array(rank, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "rank", "vec_id", "score"])

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def nearest_of_twentieths(vectors: DataFrame, k: int = 20) -> DataFrame:
    """Queries: every row whose vec_id is divisible by 20, against all rows."""
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k)
