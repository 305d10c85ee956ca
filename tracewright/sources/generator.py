"""Seeded synthetic traces."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: First second of the generated logs and the longest step between events.
START_SECOND = 1_600_086_941
MAX_STEP = 7_200


def generate(spark: SparkSession, traces: int = 100, kinds: int = 10, min_len: int = 10, max_len: int = 90,
             seed: int = 7, ids: DataFrame | None = None) -> DataFrame:
    """Uniform lengths in [min_len, max_len], uniform types, steps under two hours.

    ``ids`` (one column ``id``) replaces the ids 0..traces-1. Every value is a hash of (seed, id, position), so the
    log is the same at any partitioning.
    """
    if not 0 < min_len <= max_len or kinds < 1:
        raise ValueError("0 < min_len <= max_len and kinds >= 1 are needed")
    base = ids.select(F.col("id").cast("long")) if ids is not None else spark.range(traces)
    width = max(1, round(math.sqrt(kinds)))
    draw = lambda salt, *c: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *c), F.lit(1 << 40))
    n = (F.lit(min_len) + draw("len", F.col("id")) % (max_len - min_len + 1)).cast("int")
    rows = base.select("id", F.posexplode(F.sequence(F.lit(1), n)).alias("position", "_"))
    kind = (draw("type", F.col("id"), F.col("position")) % kinds).cast("string")
    name = F.concat(kind, F.lit("x"), F.substring(F.md5(F.concat(F.lit(f"{seed}-"), kind)), 1, width))
    step = draw("step", F.col("id"), F.col("position")) % MAX_STEP
    order = Window.partitionBy("id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(F.col("id").cast("string").alias("trace_id"), name.alias("event_type"), "position",
                       F.timestamp_seconds(F.lit(START_SECOND) + F.sum(step).over(order)).cast("timestamp_ntz").alias("ts"))
