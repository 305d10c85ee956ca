"""Skip-till-next-match event pairs."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import DAY_MS, millis, seconds_between, within_lookback


def with_other_types(log: DataFrame) -> DataFrame:
    """Each event once for every type of its trace (column ``other``). One shuffle, by trace, serves all that follows."""
    trace = Window.partitionBy("trace_id")
    typed = log.select("trace_id", "event_type", "position", "ts").withColumn("_types", F.collect_set("event_type").over(trace))
    return typed.select("trace_id", "event_type", "position", "ts", F.explode("_types").alias("other"))


def with_next_other(log: DataFrame) -> DataFrame:
    """Adds ``nxt``: position and time of the next event of type ``other`` in the trace, null if none."""
    later = Window.partitionBy("trace_id", "other").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.when(F.col("event_type") == F.col("other"), F.struct("position", "ts"))
    return with_other_types(log).withColumn("nxt", F.last(hit, ignorenulls=True).over(later))


def extract_pairs(log: DataFrame, lookback_days: int = 30, starts: DataFrame | None = None, compat_ties: bool = False) -> DataFrame:
    """Non-overlapping pairs (A, B), A = B included.

    The pair that ends at b starts at the earliest A after the previous B (at it, if A = B) and within the lookback.
    Non-overlap goes by position. ``starts`` (trace_id, start) keeps only pairs that end at or after a trace's first
    new position. ``compat_ties`` compares timestamps instead, so events at one instant may share pairs.
    """
    if compat_ties:
        pairs = _pairs_by_time(log, lookback_days)
    else:
        ahead = with_next_other(log).filter(F.col("nxt").isNotNull() & within_lookback(F.col("ts"), F.col("nxt.ts"), lookback_days))
        if starts is not None:  # before the pairs are made
            ahead = ahead.join(starts.select("trace_id", "start"), "trace_id").filter(F.col("nxt.position") >= F.col("start"))
        pairs = (ahead.groupBy("trace_id", F.col("event_type").alias("eventA"), F.col("other").alias("eventB"),
                               F.col("nxt.position").alias("positionB"), F.col("nxt.ts").alias("timeB"))
                 .agg(F.min("position").alias("positionA"), F.min_by("ts", "position").alias("timeA")))
    if compat_ties and starts is not None:
        pairs = pairs.join(starts, "trace_id").filter(F.col("positionB") >= F.col("start"))
    return pairs.select("eventA", "eventB", "trace_id", "timeA", "timeB", "positionA", "positionB")


def greedy_pairs(events: list[tuple[str, int, int]], lookback_ms: int) -> list[tuple[str, str, int, int]]:
    """(type, position, ms) of one trace to (A, B, posA, posB) where non-overlap compares times."""
    by: dict[str, list[tuple[int, int]]] = {}
    for kind, pos, ms in sorted(events, key=lambda e: e[1]):
        by.setdefault(kind, []).append((pos, ms))
    out = []
    for a, firsts in by.items():
        for b, seconds in by.items():
            free, k = None, 0
            for pos, ms in firsts:
                if free is not None and ms < free:
                    continue
                while k < len(seconds) and seconds[k][0] <= pos:
                    k += 1
                if k == len(seconds):
                    break
                if seconds[k][1] - ms <= lookback_ms:
                    out.append((a, b, pos, seconds[k][0]))
                    free, k = seconds[k][1], k + 1
    return out


def _pairs_by_time(log: DataFrame, lookback_days: int) -> DataFrame:
    """A trace is one group here; use it for logs whose traces fit a task."""
    schema = "eventA string, eventB string, trace_id string, positionA int, positionB int"

    def one(pdf):
        import pandas as pd

        rows = greedy_pairs(list(zip(pdf.event_type, pdf.position, pdf.ms, strict=True)), lookback_days * DAY_MS)
        out = pd.DataFrame(rows, columns=["eventA", "eventB", "positionA", "positionB"])
        return out.assign(trace_id=pdf.trace_id.iloc[0])[["eventA", "eventB", "trace_id", "positionA", "positionB"]]

    found = log.select("trace_id", "event_type", "position", millis(F.col("ts")).alias("ms")).groupBy("trace_id").applyInPandas(one, schema)
    at = log.select("trace_id", "position", "ts")
    return (found.join(at.select("trace_id", F.col("position").alias("positionA"), F.col("ts").alias("timeA")), ["trace_id", "positionA"])
            .join(at.select("trace_id", F.col("position").alias("positionB"), F.col("ts").alias("timeB")), ["trace_id", "positionB"]))


def last_checked(pairs: DataFrame) -> DataFrame:
    """End of the last pair of each (A, B, trace)."""
    return pairs.groupBy("eventA", "eventB", "trace_id").agg(F.max_by("timeB", "positionB").alias("timestamp"))


def merge_last_checked(old: DataFrame, new: DataFrame, min_ts: str | None = None, lookback_days: int = 30) -> DataFrame:
    """New rows win; rows a lookback or more before ``min_ts`` (first event of the batch) are dropped."""
    key = ["eventA", "eventB", "trace_id"]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    merged = both.groupBy(*key).agg(F.max_by("timestamp", "_new").alias("timestamp"))
    if min_ts is None:
        return merged
    return merged.filter(millis(F.lit(min_ts).cast("timestamp_ntz")) - millis(F.col("timestamp")) < lookback_days * DAY_MS)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Duration statistics in seconds by (A, B); partial sums are made before the shuffle."""
    d = seconds_between(F.col("timeA"), F.col("timeB"))
    return (pairs.select("eventA", "eventB", d.alias("_d")).groupBy("eventA", "eventB")
            .agg(F.sum("_d").alias("sum_duration"), F.count("*").alias("count"), F.min("_d").alias("min_duration"),
                 F.max("_d").alias("max_duration"), F.sum((F.col("_d") * F.col("_d")).cast("double")).alias("sum_squares")))


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds two count tables."""
    return (old.unionByName(new).groupBy("eventA", "eventB")
            .agg(*(F.sum(c).alias(c) for c in ("sum_duration", "count")), F.min("min_duration").alias("min_duration"),
                 F.max("max_duration").alias("max_duration"), F.sum("sum_squares").alias("sum_squares")))


def nest_counts(counts: DataFrame) -> DataFrame:
    """One row for each A with an array over its B."""
    cols = ("eventB", "sum_duration", "count", "min_duration", "max_duration", "sum_squares")
    return counts.groupBy("eventA").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("times"))
