"""Stateful pair extraction and its sinks."""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.functions import DAY_MS
from tracewright.model import COUNT, EVENT, PAIR
from tracewright.operators.pairs import merge_counts, pair_counts
from tracewright.sources.store import TableStore

WATERMARK = "2 minutes"
_STATE = "n int, types array<string>, positions array<int>, millis array<long>, last_types array<string>, last_positions array<int>, last long"
_OUT = "eventA string, eventB string, trace_id string, timeA timestamp, timeB timestamp, positionA int, positionB int"


def next_pairs(state: dict, events: list[tuple[str, int]], lookback_ms: int) -> list[tuple]:
    """Feeds (type, ms) in time order to a trace's state; gives (A, B, posA, posB, msA, msB).

    state: n, the next position; open, {type: [(pos, ms)]} of events within the lookback; last, {type: pos}.
    """
    out = []
    for kind, ms in events:
        pos, state["n"] = state["n"], state["n"] + 1
        before = state["last"].get(kind, -1)
        for a, seen in state["open"].items():
            while seen and ms - seen[0][1] > lookback_ms:
                seen.pop(0)
            hit = next(((p, t) for p, t in seen if p > before or (a == kind and p == before)), None)
            if hit:
                out.append((a, kind, hit[0], pos, hit[1], ms))
        state["open"].setdefault(kind, []).append((pos, ms))
        state["last"][kind] = pos
    return out


def stream_pairs(events: DataFrame, lookback_days: int = 30, late: bool = True) -> DataFrame:
    """``events``: trace, event_type, timestamp. Positions count the arrivals of a trace, each micro-batch in time order.
    Without ``late`` events are dropped as by ``drop_late`` (here, since stateful operators do not chain)."""
    lookback = lookback_days * DAY_MS

    def step(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            # past the lookback no stored event can pair any more; the position counter stays
            group.update((group.get[0], [], [], [], [], [], group.get[6]))
            return
        state, last = {"n": 0, "open": {}, "last": {}}, -(1 << 62)
        if group.exists:
            n, types, positions, millis, lt, lp, last = group.get
            state["n"], state["last"] = n, dict(zip(lt, lp, strict=True))
            for k, p, m in zip(types, positions, millis, strict=True):
                state["open"].setdefault(k, []).append((p, m))
        pdf = pd.concat(list(frames))
        us = pdf["timestamp"].astype("datetime64[us]").astype("int64")
        top = int(pdf["timestamp"].max().timestamp() * 1000)
        pdf, last = (pdf if late else pdf[us > last]), max(last, int(us.max()))
        pdf = pdf.assign(ms=pdf["timestamp"].astype("datetime64[ms]").astype("int64")).sort_values(["ms", "position"], kind="stable")
        rows = next_pairs(state, list(zip(pdf.event_type, pdf.ms, strict=True)), lookback)
        kept = [(k, p, m) for k, v in state["open"].items() for p, m in v]
        group.update((state["n"], [x[0] for x in kept], [int(x[1]) for x in kept], [int(x[2]) for x in kept], list(state["last"]), [int(x) for x in state["last"].values()], last))
        group.setTimeoutTimestamp(max(top, group.getCurrentWatermarkMs() + 1) + lookback)
        out = pd.DataFrame(rows, columns=["eventA", "eventB", "positionA", "positionB", "a", "b"])
        for c, ms in (("timeA", "a"), ("timeB", "b")):
            out[c] = pd.to_datetime(out[ms].astype("int64"), unit="ms")
        yield out.assign(trace_id=key[0])[["eventA", "eventB", "trace_id", "timeA", "timeB", "positionA", "positionB"]]

    return (events.withWatermark("timestamp", WATERMARK).groupBy("trace")
            .applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout))


def drop_late(events: DataFrame) -> DataFrame:
    """Drops events that are not later than the last one seen of their trace (optional, before all sinks)."""
    schema = "trace string, event_type string, timestamp timestamp, position int"

    def step(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        last = group.get[0] if group.exists else -(1 << 62)
        pdf = pd.concat(list(frames)).sort_values("timestamp", kind="stable")
        us = pdf["timestamp"].astype("datetime64[us]").astype("int64")
        group.update((max(last, int(us.max())),))
        yield pdf[us > last][["trace", "event_type", "timestamp", "position"]]

    return events.groupBy("trace").applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)


class MetricsListener(StreamingQueryListener):
    """Keeps starts, progress (batch, rows, duration) and ends of queries; ``write`` gets each record as a JSON string."""

    def __init__(self, write):
        self.write = write

    def _put(self, **x):
        self.write(json.dumps(x))

    def onQueryStarted(self, event):
        self._put(event="started", id=str(event.id), name=event.name, at=event.timestamp)

    def onQueryProgress(self, event):
        p = event.progress
        self._put(event="progress", id=str(p.id), name=p.name, batch=p.batchId, rows=p.numInputRows, ms=p.batchDuration, at=p.timestamp)

    def onQueryIdle(self, event):
        self._put(event="idle", id=str(event.id), at=event.timestamp)

    def onQueryTerminated(self, event):
        self._put(event="terminated", id=str(event.id), error=event.exception)


def lines_to(path: str):
    """A sink of records for the listener: one line each, at the end of a file of the driver."""
    def write(record: str) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.write(record + "\n")

    return write


def run_stream(store: TableStore, events: DataFrame, lookback_days: int = 30, available_now: bool = False, late: bool = True, metrics=None) -> list:
    """Two queries with checkpoints: events to the sequence and single tables, pairs to the index and count tables.

    A batch that is written again after a failure replaces its own folder, so both sinks take each batch once. Without
    ``late`` events are dropped that are not later than the last one of their trace. ``metrics`` gets the listener's records.
    """
    spark = store.spark
    if metrics is not None:
        spark.streams.addListener(MetricsListener(metrics))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def put(table, df, batch_id, by=None):
        w = df.write.mode("overwrite").option("compression", store.compression)
        (w.partitionBy(by) if by else w).parquet(store.path(f"stream_{table}", f"batch={batch_id}"))

    def sink_events(df, batch_id):
        df = df.select(F.col("trace").alias("trace_id"), "event_type", "position", F.col("timestamp").cast("timestamp_ntz").alias("ts"))
        put("sequence", df, batch_id)
        put("single", df, batch_id, "event_type")

    def sink_pairs(df, batch_id):
        pairs = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("timeA", "timeB")})
        put("index", pairs, batch_id, "eventA")
        # the totals of batch n are made from those of batch n - 1, so a repeated batch gives the same totals
        back = spark.read.schema(PAIR).parquet(store.path("stream_index", f"batch={batch_id}"))
        new, before = pair_counts(back), store.path("stream_count", f"batch={batch_id - 1}")
        put("count", merge_counts(spark.read.schema(COUNT).parquet(before), new) if batch_id else new, batch_id)

    out = []
    for name, df, fn in (("events", events if late else drop_late(events), sink_events), ("pairs", stream_pairs(events, lookback_days, late), sink_pairs)):
        w = df.writeStream.queryName(f"{store.log_name}_{name}").foreachBatch(fn).option("checkpointLocation", store.path("checkpoints", name))
        out.append((w.trigger(availableNow=True) if available_now else w).start())
    return out


def read_stream(store: TableStore, table: str, schema: T.StructType) -> DataFrame:
    """What a stream has written to a table so far; empty before its first batch. Of the counts, the last batch holds all."""
    path = store._path(store.path(f"stream_{table}"))
    batches = [int(s.getPath().getName().split("=")[1]) for s in store._fs.listStatus(path) if s.getPath().getName().startswith("batch=")] if store._fs.exists(path) else []
    if not batches:
        return store.spark.createDataFrame([], schema)
    pick = [max(batches)] if table == "count" else sorted(batches)
    found = store.spark.read.schema(schema).option("basePath", store.path(f"stream_{table}"))
    return found.parquet(*(store.path(f"stream_{table}", f"batch={b}") for b in pick)).select(*schema.names)


def stream_metadata(store: TableStore) -> DataFrame:
    """Traces, events and pairs so far, from the tables."""
    facts = read_stream(store, "sequence", EVENT).agg(F.count_distinct("trace_id").alias("traces"), F.count("*").alias("events"))
    return facts.join(F.broadcast(read_stream(store, "index", PAIR).agg(F.count("*").alias("pairs"))))  # two rows of one each
