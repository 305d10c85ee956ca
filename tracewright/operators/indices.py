"""Single-event indices, positions and log statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def single_index(log: DataFrame) -> DataFrame:
    """(trace, type) to its ordered occurrences."""
    return log.groupBy("trace_id", "event_type").agg(F.sort_array(F.collect_list(F.struct("position", "ts"))).alias("occurrences"))


def single_index_by_type(log: DataFrame) -> DataFrame:
    """Type to its occurrences by trace: a row for each type and trace, so a frequent type is many rows and no large one.
    Stored with ``event_type`` as the partition column, a type is read alone."""
    return single_index(log).select("event_type", "trace_id", "occurrences")


def last_positions(log: DataFrame) -> DataFrame:
    """Next free position of each trace."""
    return log.groupBy("trace_id").agg((F.max("position") + 1).alias("next_position"))


def repair_positions(batch: DataFrame, stored_next: DataFrame) -> DataFrame:
    """Positions of a batch go on from what is stored."""
    return (batch.join(stored_next, "trace_id", "left")
            .withColumn("position", (F.col("position") + F.coalesce("next_position", F.lit(0))).cast("int")).drop("next_position"))


def single_index_full(batch: DataFrame, stored_next: DataFrame) -> DataFrame:
    """Single index of the new events of a batch with their final positions."""
    return single_index(repair_positions(batch, stored_next))


def event_type_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("event_type").agg(F.count("*").alias("n"))


def trace_lengths(log: DataFrame) -> DataFrame:
    return log.groupBy("trace_id").agg(F.count("*").alias("n"))


def metadata_summary(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """traces, events, pairs, start_ts, last_ts as one row."""
    facts = log.agg(F.count_if(F.col("position") == 0).alias("traces"), F.count("*").alias("events"),
                    F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"))
    return facts.join(F.broadcast(pairs.agg(F.count("*").alias("pairs"))))  # two rows of one each


def changed_traces(log: DataFrame, after: str) -> DataFrame:
    """Traces with events after a moment: first and last new position."""
    return (log.filter(F.col("ts") > F.lit(after).cast("timestamp_ntz")).groupBy("trace_id")
            .agg(F.min("position").alias("start"), F.max("position").alias("end")))


def directly_follows(log: DataFrame) -> DataFrame:
    """How often B is the event right after A."""
    nxt = F.lead("event_type").over(Window.partitionBy("trace_id").orderBy("position"))
    return (log.select(F.col("event_type").alias("eventA"), nxt.alias("eventB")).filter("eventB IS NOT NULL")
            .groupBy("eventA", "eventB").agg(F.count("*").alias("n")))
