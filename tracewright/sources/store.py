"""Tables under root/log_name. A manifest names the folders that make up each table; a transaction writes new folders and then
one new manifest, so either all of its tables change or none does.

No plan ever overwrites what it reads. A job that dies leaves folders that no manifest names; running it again starts from the
last manifest and gives what one clean run gives.
"""
from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracewright.model import CODECS


class Store(Protocol):
    """What indexing and mining need of a store; another one may be plugged in."""

    spark: SparkSession
    log_name: str

    def read(self, table: str, schema: T.StructType | None = None) -> DataFrame: ...

    def overwrite(self, table: str, df: DataFrame, partition_by: str | None = None) -> None: ...

    def append(self, table: str, df: DataFrame, partition_by: str | None = None) -> None: ...

    def transaction(self) -> AbstractContextManager[None]: ...

    def delete_log(self) -> None: ...

    def delete_all(self) -> None: ...


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that the cluster names; only a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class TableStore:
    def __init__(self, spark: SparkSession, root: str, log_name: str, compression: str = "snappy"):
        if compression not in CODECS:
            raise ValueError(f"compression is one of {CODECS}")
        if not re.fullmatch(r"[\w.-]+", log_name) or log_name in (".", ".."):
            raise ValueError("log_name is a plain name")
        self.spark, self.root, self.log_name, self.compression = spark, root.rstrip("/"), log_name, compression
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._open: dict[str, list[str]] | None = None

    def path(self, *parts: str) -> str:
        return "/".join((self.root, self.log_name, *parts))

    # --- manifests ---------------------------------------------------------------------------------------------------

    def _versions(self) -> list[int]:
        p = self._path(self.path("_manifests"))
        if not self._fs.exists(p):
            return []
        return sorted(int(n) for s in self._fs.listStatus(p) if (n := s.getPath().getName()).isdigit())

    def _manifest(self, version: int) -> dict[str, list[str]]:
        stream = self._fs.open(self._path(self.path("_manifests", str(version))))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def tables(self) -> dict[str, list[str]]:
        """The folders of each table, as a transaction that is open sees them."""
        if self._open is not None:
            return self._open
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else {}

    def _commit(self, tables: dict[str, list[str]]) -> None:
        versions = self._versions()
        new = versions[-1] + 1 if versions else 1
        before = set().union(*self._manifest(versions[-1]).values()) if versions else set()
        tmp = self._path(self.path("_manifests", f"_{uuid.uuid4().hex}"))
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        if not self._fs.rename(tmp, self._path(self.path("_manifests", str(new)))):
            raise RuntimeError(f"another writer has made version {new} of {self.log_name}")
        # what the last version alone named stays for readers that have begun; what was gone before that goes
        for old in versions[:-1]:
            for folder in set().union(*self._manifest(old).values()) - before - set().union(*tables.values()):
                self._fs.delete(self._path(self.path(folder)), True)
            self._fs.delete(self._path(self.path("_manifests", str(old))), False)

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Writes inside become visible to others together, at the end; none does if it fails."""
        if self._open is not None:
            yield
            return
        self._open = {k: list(v) for k, v in self.tables().items()}
        try:
            yield
            done = self._open
        finally:
            self._open = None
        self._commit(done)

    # --- tables ------------------------------------------------------------------------------------------------------

    def read(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        """The table as it is now; an absent one is an empty frame of that schema."""
        folders = self.tables().get(table)
        if not folders:
            return self.spark.createDataFrame([], schema or T.StructType())
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        found = reader.option("basePath", self.path(table)).parquet(*(self.path(f) for f in folders))
        return found.select(*schema.names) if schema else found.drop("part")

    def overwrite(self, table: str, df: DataFrame, partition_by: str | None = None) -> None:
        with self.transaction():
            folder = self._write(table, df, partition_by)
            self._open[table] = [folder]

    def append(self, table: str, df: DataFrame, partition_by: str | None = None) -> None:
        with self.transaction():
            folder = self._write(table, df, partition_by)
            self._open[table] = [*self._open.get(table, []), folder]

    def _write(self, table: str, df: DataFrame, partition_by: str | None) -> str:
        folder = f"{table}/part=p{uuid.uuid4().hex}"
        if partition_by:
            # rebalance splits a hot value over several tasks and still writes few files
            df = df.hint("rebalance", partition_by)
        w = df.write.option("compression", self.compression)
        (w.partitionBy(partition_by) if partition_by else w).parquet(self.path(folder))
        return folder

    def delete_log(self) -> None:
        self._fs.delete(self._path(self.path()), True)

    def delete_all(self) -> None:
        """Deletes every log under the root, and nothing else."""
        root = self._path(self.root)
        if self._fs.exists(root):
            for s in self._fs.listStatus(root):
                self._fs.delete(s.getPath(), True)
