"""Concurrency, enablement and start-time estimation. Logs here have ``resource``; ``ts`` is the end of an event."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import floor_hour_before, seconds_between
from tracewright.operators.indices import directly_follows


def short_loops(log: DataFrame) -> DataFrame:
    """Pairs of types seen as A-B-A."""
    w = Window.partitionBy("trace_id").orderBy("position")
    near = log.select(F.lag("event_type").over(w).alias("eventA"), F.col("event_type").alias("eventB"), F.lead("event_type").over(w).alias("_c"))
    return near.filter("eventA = _c AND eventA <> eventB").select("eventA", "eventB").distinct()


def concurrent_pairs(log: DataFrame) -> DataFrame:
    """A and B follow each other both ways, make no short loop, and not only one way counts."""
    ab = directly_follows(log)
    ba = ab.select(F.col("eventA").alias("eventB"), F.col("eventB").alias("eventA"), F.col("n").alias("m"))
    loops = short_loops(log)
    both = loops.unionByName(loops.select(F.col("eventB").alias("eventA"), F.col("eventA").alias("eventB"))).distinct()
    return (ab.join(ba, ["eventA", "eventB"]).filter("eventA <> eventB AND abs(n - m) / (n + m) < 1")
            .join(both, ["eventA", "eventB"], "left_anti").select("eventA", "eventB"))


def enablement(log: DataFrame, concurrent: DataFrame | None = None) -> DataFrame:
    """Adds ``enabled_ts``: the full hour before a first event; else the end of the previous event, or what enabled that
    one if the two are concurrent."""
    w = Window.partitionBy("trace_id").orderBy("position")
    step = log.withColumns({"_pt": F.lag("event_type").over(w), "_pts": F.lag("ts").over(w)})
    conc = (concurrent if concurrent is not None else concurrent_pairs(log)).select(
        F.col("eventA").alias("_pt"), F.col("eventB").alias("event_type"), F.lit(True).alias("_conc"))
    step = step.join(conc, ["_pt", "event_type"], "left")
    # an event concurrent to its predecessor takes over the predecessor's enablement: the last value that is not null
    own = F.when(F.col("_pts").isNull(), floor_hour_before(F.col("ts"))).when(F.col("_conc").isNull(), F.col("_pts"))
    held = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn("enabled_ts", held).drop("_pt", "_pts", "_conc")


#: Width of a bucket of time, in microseconds: no task holds more of a resource than an hour of it.
BUCKET_US = 3_600_000_000


def start_times(log: DataFrame, concurrent: DataFrame | None = None) -> DataFrame:
    """Adds ``start_ts`` (the later of enablement and the resource's last earlier end) and ``waiting_time`` in seconds.

    The last earlier end is looked for in the event's own hour, then in the last one before that has any: a busy resource is
    split by time, and only a row for each of its hours meets in one task.
    """
    ready = enablement(log, concurrent)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ready = ready.withColumn("_us", micros).withColumn("_hour", F.floor(F.col("_us") / BUCKET_US))
    # RANGE up to 1 microsecond before: strictly earlier ends, ties left out
    near = Window.partitionBy("resource", "_hour").orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("resource").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = ready.filter("resource IS NOT NULL").groupBy("resource", "_hour").agg(F.max("ts").alias("_end"))
    carried = hours.select("resource", "_hour", F.max("_end").over(before).alias("_carried"))
    out = ready.withColumn("_near", F.max("ts").over(near)).join(carried, ["resource", "_hour"], "left")
    free = F.when(F.col("resource").isNotNull(), F.coalesce("_near", "_carried"))
    start = F.greatest("enabled_ts", free)
    return (out.withColumn("start_ts", start).withColumn("waiting_time", seconds_between(F.col("enabled_ts"), F.col("start_ts")))
            .select(*log.columns, "enabled_ts", "start_ts", "waiting_time"))
