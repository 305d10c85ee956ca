"""Event-log readers: every reader gives (trace_id, event_type, position, ts[, resource])."""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.model import STREAM_MESSAGE

#: The text format of the logs.
TRACE_SEPARATOR = "::"
FIELD_DELIMITER = "/delab/"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

_READERS: dict[str, Callable[..., DataFrame]] = {}


def register_reader(suffix: str, fn: Callable[..., DataFrame]) -> None:
    """Adds a format; ``fn(spark, path, detailed=False, separator=',')``."""
    _READERS[suffix.lower()] = fn


def read_log(spark: SparkSession, path: str, detailed: bool = False, separator: str = ",") -> DataFrame:
    """Reads by the real suffix (the text after the last dot of the file name)."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if suffix not in _READERS:
        raise ValueError(f"Not recognised file type: {suffix!r}")
    return _READERS[suffix](spark, path, detailed=detailed, separator=separator)


def parse_with_timestamp(lines: DataFrame, detailed: bool = False, separator: str = ",") -> DataFrame:
    """Lines ``trace::type/delab/ts[/delab/resource],...`` in column ``value``."""
    head = F.split("value", TRACE_SEPARATOR, 2)
    events = lines.filter(F.col("value").contains(TRACE_SEPARATOR)).select(
        F.trim(head[0]).alias("trace_id"), F.posexplode(F.split(head[1], _quoted(separator))).alias("position", "_e"))
    field = F.split("_e", FIELD_DELIMITER)
    out = events.select("trace_id", F.trim(field[0]).alias("event_type"), "position",
                        F.to_timestamp_ntz(F.trim(field[1]), F.lit(TS_FORMAT)).alias("ts"),
                        *([F.get(field, F.lit(2)).alias("resource")] if detailed else []))
    return out


def _quoted(separator: str) -> str:
    return r"\Q" + separator + r"\E"


def _with_timestamp(spark, path, detailed=False, separator=","):
    return parse_with_timestamp(spark.read.text(path), detailed, separator)


def _txt(spark, path, detailed=False, separator=","):
    """One trace a line. Line numbers come from per-partition counts, so no row leaves its partition."""
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("_id"), "value")
    part, local = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    lines = lines.withColumns({"_part": part, "_local": local})
    sizes = lines.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = lines.join(before, "_part").withColumn("trace_id", (F.col("_before") + F.col("_local")).cast("string"))
    events = numbered.select("trace_id", F.posexplode(F.split("value", _quoted(separator))).alias("position", "event_type"))
    return events.select("trace_id", F.trim("event_type").alias("event_type"), "position",
                         F.timestamp_seconds("position").cast("timestamp_ntz").alias("ts"),
                         *([F.lit(None).cast("string").alias("resource")] if detailed else []))


_KV = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))
_XES = T.StructType([
    T.StructField("string", _KV),
    T.StructField("event", T.ArrayType(T.StructType([T.StructField("string", _KV), T.StructField("date", _KV)])))])


def _attribute(entries: Column, key: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["_key"] == key), F.lit(0))["_value"]


def _xes(spark, path, detailed=False, separator=","):
    """XES by the XML source; the wall time is kept, zone and fraction are dropped."""
    raw = spark.read.format("xml").option("rowTag", "trace").schema(_XES).load(path)
    events = raw.select(_attribute(F.col("string"), "concept:name").alias("trace_id"),
                        F.posexplode("event").alias("position", "_e"))
    ts = F.substring(_attribute(F.col("_e.date"), "time:timestamp"), 1, 19)
    return events.select("trace_id", _attribute(F.col("_e.string"), "concept:name").alias("event_type"), "position",
                         F.to_timestamp_ntz(ts, F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("ts"),
                         *([_attribute(F.col("_e.string"), "org:resource").alias("resource")] if detailed else []))


register_reader("withtimestamp", _with_timestamp)
register_reader("txt", _txt)
register_reader("xes", _xes)


def event_log(table: DataFrame, trace: str, kind: str | Column, ts: str, tie: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Any table as an event log: positions count from 0 in (ts, tie, type) order within the trace."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    order = Window.partitionBy("trace_id").orderBy("ts", "_tie", "event_type")
    return (table.select(F.col(trace).cast("string").alias("trace_id"), kind.alias("event_type"),
                         F.col(ts).cast("timestamp_ntz").alias("ts"), F.col(tie).alias("_tie"), *extra)
            .withColumn("position", F.row_number().over(order) - 1)
            .select("trace_id", "event_type", "position", "ts", *extra))


def decode_messages(raw: DataFrame) -> DataFrame:
    """Stream messages: JSON in ``value`` to columns; works for batch and streaming frames."""
    return raw.select(F.from_json(F.col("value").cast("string"), STREAM_MESSAGE).alias("json")).select("json.*")


def messages(log: DataFrame) -> DataFrame:
    """An event log as stream messages: JSON in ``value``."""
    return log.select(F.to_json(F.struct(F.col("trace_id").alias("trace"), "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "position")).alias("value"))


def replay(log: DataFrame, folder: str, parts: int = 3) -> Iterator[int]:
    """Replays a log for a stream that reads text from ``folder``: its messages in ``parts`` equal stretches of time, one after
    another; gives the number of each once it is written."""
    lo, hi = log.agg(F.min("ts"), F.max("ts")).first()
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    span = us(F.lit(hi).cast("timestamp_ntz")) - us(F.lit(lo).cast("timestamp_ntz")) + 1
    at = F.floor((us(F.col("ts")) - us(F.lit(lo).cast("timestamp_ntz"))) * parts / span)
    for part in range(parts):
        messages(log.filter(at == part)).write.mode("append").text(folder)
        yield part


def stream_source(spark: SparkSession, fmt: str = "kafka", **options: str) -> DataFrame:
    """A raw stream with a ``value`` column. Kafka by default; ``fmt='text'`` reads JSON lines from a folder."""
    base = {"startingOffsets": "latest", "minOffsetsPerTrigger": "1000", "maxTriggerDelay": "10s"} if fmt == "kafka" else {}
    return spark.readStream.format(fmt).options(**(base | options)).load()
