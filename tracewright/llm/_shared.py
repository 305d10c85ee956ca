"""What the operators of this package share: work folders, files, hashing of words."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64


#: Open lists of the work folders that were named since; see ``folders``.
_NAMED: list[list[str]] = []
#: Most ids in a broadcast (some tens of MB); what is larger is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that the cluster names. Only a local session without one gets its own."""
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for held in _NAMED:
        held.append(path)
    return path


@contextmanager
def folders() -> Iterator[list[str]]:
    """The work folders that are named inside; whoever has written what was read from them may ``discard`` them."""
    held: list[str] = []
    _NAMED.append(held)
    try:
        yield held
    finally:
        _NAMED.pop()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes work folders that nothing will read any more."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sized(ids: DataFrame) -> DataFrame:
    """A table of ids (which must be cheap to read twice) marked for a broadcast if it is small; the join shuffles it else."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def small_batches(spark: SparkSession) -> None:
    """Documents are long rows: no more than 2000 of them and about 4 MB go to a Python worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > 2000:
        spark.conf.set(name, "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def settle(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: the lineage ends there, and a lost executor costs nothing."""
    w = df.write.option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(path: str):
    """(file system, path) for a URI or a local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def write_file(path: str, parts: list[bytes]) -> None:
    """Writes under another name, then moves: a task that runs again replaces a whole file by an equal one."""
    system, p = file_system(path)
    tmp = f"{p}.{uuid.uuid4().hex}"
    system.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(tmp) as f:
        for x in parts:
            f.write(x)
    system.move(tmp, p)


def read_file(path: str, start: int = 0, length: int | None = None) -> bytes:
    system, p = file_system(path)
    with system.open_input_file(p) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()


def in_fold(key: str, modulus: int, remainder: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``, is ``remainder``."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(modulus)) == remainder


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def _cached_powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = _powers(base, max(n, _BLOCK + 1))
    return _POWERS[base][:n]


_at = np.arange(256)
#: Bytes of words: everything but ASCII white space (SPACED), or ASCII letters, digits and all of non-ASCII (ALNUM).
SPACED = ~((_at == 32) | ((_at >= 9) & (_at <= 13)))
ALNUM = (_at >= 128) | ((_at >= 48) & (_at <= 57)) | ((_at >= 97) & (_at <= 122)) | ((_at >= 65) & (_at <= 90))


def byte_words(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a byte array. A word's hash depends on its bytes alone."""
    starts, ends, hashes = [], [], []
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + _BLOCK)
        while stop < n and kind[data[stop]]:  # a block ends between words
            more = np.flatnonzero(~kind[data[stop:stop + _BLOCK]])
            stop = stop + int(more[0]) if len(more) else min(n, stop + _BLOCK)
            if len(more):
                break
        block = data[at:stop]
        word = np.zeros(len(block) + 2, dtype=np.int8)
        word[1:-1] = kind[block]
        edge = np.diff(word)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(block) + 1, dtype=U)
        np.cumsum(_BYTES[block] * _cached_powers(_P, len(block)), out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * _cached_powers(_PINV, len(block) + 1)[s] + (e - s).astype(U)))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    if not starts:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(0, dtype=U)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of an integer array; a hash depends on the run's values alone."""
    sums = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(mix(values.astype(U) + U(_P)) * _cached_powers(_P, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _cached_powers(_PINV, len(values) + 1)[starts] + (ends - starts).astype(U))


def doc_words(texts: list[str | None], kind: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the words of text i have the hashes[offsets[i]:offsets[i + 1]]. Null is empty."""
    raw = [((t.lower() if lower else t) if t else "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    s, _, h = byte_words(np.frombuffer(b"\n".join(raw), dtype=np.uint8), kind)
    return np.searchsorted(s, at), h


def shingles(offsets: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles: (document index, hash) in order. A text of 1 to k - 1 words has one, of all its words."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], n)
    if len(hashes) == 0:
        return doc, hashes
    acc = np.zeros(len(hashes), dtype=U)
    left = np.repeat(n, n) - place  # words from here to the end of the text
    padded = np.concatenate([hashes, np.zeros(k, dtype=U)])
    for j in range(k):
        acc = acc * U(_P) + np.where(left > j, padded[j:j + len(hashes)], U(0))
    keep = (left >= k) | (place == 0)
    return doc[keep], mix(acc[keep])


def slices(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` characters."""
    a = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
