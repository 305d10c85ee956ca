"""Incremental batch indexing into a table store."""
from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright import model
from tracewright.functions import seconds_between
from tracewright.operators import declare, indices, pairs
from tracewright.sources.store import Store


@dataclass(frozen=True)
class Metadata:
    log_name: str
    mode: str = "positions"
    compression: str = "snappy"
    lookback: int = 30
    traces: int = 0
    events: int = 0
    pairs: int = 0
    has_previous_stored: bool = False
    filename: str = ""
    streaming: bool = False
    start_ts: str = ""
    last_ts: str = ""
    last_declare_mined: str = ""


_TYPES = {str: T.StringType(), int: T.LongType(), bool: T.BooleanType()}
META = T.StructType([T.StructField(k, _TYPES[type(v)]) for k, v in asdict(Metadata("")).items()])


def read_metadata(store: Store, default: Metadata) -> Metadata:
    """A stored record wins over the given options."""
    row = store.read("metadata", META).first()
    return Metadata(**row.asDict()) if row else default


def write_metadata(store: Store, meta: Metadata) -> None:
    store.overwrite("metadata", store.spark.createDataFrame([tuple(asdict(meta).values())], META))


def index_batch(store: Store, batch: DataFrame, options: Metadata, detailed: bool = False) -> Metadata:
    """Adds one batch to every table and gives the new metadata.

    ``batch`` has positions from 0 within the batch. Pairs are made over complete changed traces and kept where they
    end at a new event, so batches add up to one full run. All tables change together, at the end: a job that dies on the
    way and is run again adds its batch once.
    """
    if options.mode not in model.MODES:
        raise ValueError(f"mode is one of {model.MODES}")
    with store.transaction():
        return _index(store, batch, options, detailed)


def _index(store: Store, batch: DataFrame, options: Metadata, detailed: bool) -> Metadata:
    meta = read_metadata(store, options)
    stored = store.read("sequence", model.EVENT)
    keep = ["trace_id", "event_type", "position", "ts"]
    fresh = indices.repair_positions(batch, indices.last_positions(stored))
    store.overwrite("batch", fresh.select(*keep, *[c for c in ("start_ts", "waiting_time", "resource") if c in fresh.columns]))
    fresh = store.read("batch")
    facts = fresh.agg(F.count("*").alias("events"), F.count_if(F.col("position") == 0).alias("traces"),
                      F.min("ts").cast("string").alias("lo"), F.max("ts").cast("string").alias("hi")).first()
    if not facts["events"]:
        return meta
    starts = fresh.groupBy("trace_id").agg(F.min("position").alias("start"))
    log = stored.join(starts.select("trace_id"), "trace_id", "left_semi").select(*keep).unionByName(fresh.select(*keep))
    store.overwrite("batch_pairs", pairs.extract_pairs(log, meta.lookback, starts))
    found = store.read("batch_pairs", model.PAIR)

    if detailed:
        store.append("detailed", fresh)
    store.append("single", fresh.select("event_type", "trace_id", "position", "ts"), "event_type")
    new_last = pairs.last_checked(found)
    store.overwrite("last_checked", pairs.merge_last_checked(store.read("last_checked", model.LAST_CHECKED), new_last, facts["lo"], meta.lookback))
    at = ("positionA", "positionB") if meta.mode == "positions" else (F.col("timeA").alias("timestampA"), F.col("timeB").alias("timestampB"))
    store.append("index", found.select("eventA", "eventB", "trace_id", *at), "eventA")
    store.overwrite("count", pairs.nest_counts(pairs.merge_counts(_flat_counts(store), pairs.pair_counts(found))))
    store.append("sequence", fresh.select(*keep))
    meta = replace(meta, traces=meta.traces + facts["traces"], events=meta.events + facts["events"], pairs=_stored_pairs(store),
                   has_previous_stored=True, filename=options.filename or meta.filename,
                   start_ts=min(filter(None, (meta.start_ts, facts["lo"]))), last_ts=max(meta.last_ts, facts["hi"]))
    write_metadata(store, meta)
    return meta


def _stored_pairs(store: Store) -> int:
    """All pairs so far, from a row for each pair of types."""
    return _flat_counts(store).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]


_ITEM = T.StructType([f for f in model.COUNT.fields if f.name != "eventA"])
NESTED_COUNT = T.StructType([T.StructField("eventA", T.StringType()), T.StructField("times", T.ArrayType(_ITEM))])


def _flat_counts(store: Store) -> DataFrame:
    return store.read("count", NESTED_COUNT).select("eventA", F.inline("times")).select(*model.COUNT.names)


def index_schema(mode: str) -> T.StructType:
    a, b, t = ("positionA", "positionB", T.IntegerType()) if mode == "positions" else ("timestampA", "timestampB", T.TimestampNTZType())
    return T.StructType([T.StructField(n, T.StringType()) for n in ("eventA", "eventB", "trace_id")] + [T.StructField(n, t) for n in (a, b)])


_STATES = {
    "position": (declare.first_last, model.POSITION_STATE, "occurrences"), "existence": (declare.exactly_n, model.EXISTENCE_STATE, "contained"),
    "unordered_u": (declare.unordered_u, model.UNORDERED_U, "count"), "unordered_i": (declare.unordered_i, model.UNORDERED_I, "count"),
    "order": (declare.order_state, model.ORDER_STATE, "occurrences"),
}


def mine_constraints(store: Store) -> None:
    """Brings the constraint states up to the stored sequences. What was mined of each trace is kept by position, so late
    events count too. All states change together, so a job that is run again counts nothing twice."""
    with store.transaction():
        _mine(store)


def _mine(store: Store) -> None:
    log = store.read("sequence", model.EVENT)
    mined = store.read("declare_mined", model.MINED)
    ends = log.groupBy("trace_id").agg((F.max("position") + 1).cast("int").alias("now"))
    starts = (ends.join(mined, "trace_id", "left").withColumn("start", F.coalesce("mined", F.lit(0)))
              .filter("now > start").select("trace_id", "start"))
    changed = log.join(starts.select("trace_id"), "trace_id", "left_semi")
    for name, (fn, schema, value) in _STATES.items():
        change = fn(changed, starts).withColumn(value, F.col(value).cast("long"))
        store.overwrite(f"declare_{name}", declare.merge_state(store.read(f"declare_{name}", schema), change.select(*_cast(schema)), value))
    order = store.read("declare_order", model.ORDER_STATE)
    store.overwrite("declare_negatives", declare.negatives(declare.activity_matrix(log), order))
    store.overwrite("declare_mined", ends.withColumnRenamed("now", "mined"))
    meta = read_metadata(store, Metadata(store.log_name))
    write_metadata(store, replace(meta, last_declare_mined=meta.last_ts))


def _cast(schema: T.StructType):
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]


def waiting_columns(log: DataFrame, concurrent: DataFrame | None = None) -> DataFrame:
    """Detailed log with start_ts and waiting_time."""
    from tracewright.operators.durations import start_times

    return start_times(log, concurrent).drop("enabled_ts").withColumn("waiting_time", F.coalesce("waiting_time", seconds_between(F.col("ts"), F.col("ts"))))
