"""Connected components by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._shared import settle, work_dir


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected links to (id, root), root being the smallest id of the component; ids without links are left out.

    Every step hangs the neighbours of an id under its smallest one. Minima are partial aggregates and the join back can
    be split, so a hub with a third of all links is no single task. Edges never grow in number and stay in tables.
    """
    root = work_dir(links.sparkSession, "components")
    edges = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), f"{root}/0")
    state, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large, f"{root}/{step}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        step += 1
        edges = settle(small.select("e.u", "e.v").filter("u <> v").distinct(), f"{root}/{step}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
