"""State behind DECLARE constraints.

Every function takes the complete events of the traces at hand and ``starts`` (trace_id, start: first new position;
None: everything is new) and gives the *change* of the state; over whole traces from 0 that is the state itself.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.pairs import with_next_other


def _started(log: DataFrame, starts: DataFrame | None) -> DataFrame:
    """Adds ``start``."""
    return log.withColumn("start", F.lit(0)) if starts is None else log.join(starts.select("trace_id", "start"), "trace_id")


def first_last(log: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``first`` at position 0, else ``last`` at the end; an extended trace takes back its former ``last``."""
    ends = (_started(log, starts).groupBy("trace_id", "start")
            .agg(F.max("position").alias("end"), F.min_by("event_type", "position").alias("first"), F.max_by("event_type", "position").alias("last"),
                 F.max(F.when(F.col("position") == F.col("start") - 1, F.col("event_type"))).alias("former")))
    entry = lambda rule, kind, n, ok: F.when(ok, F.struct(F.lit(rule).alias("rule"), F.col(kind).alias("event_type"), F.lit(n).alias("n")))
    rows = ends.select(F.explode(F.array(
        entry("first", "first", 1, F.col("start") == 0), entry("last", "last", 1, F.col("end") > 0),
        entry("last", "former", -1, F.col("start") > 1))).alias("e")).filter("e IS NOT NULL")
    return rows.groupBy("e.rule", "e.event_type").agg(F.sum("e.n").alias("occurrences")).filter("occurrences <> 0")


def exactly_n(log: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """In how many traces a type occurs exactly ``occurrences`` times."""
    per = (_started(log, starts).groupBy("trace_id", "event_type")
           .agg(F.count("*").alias("now"), F.count_if(F.col("position") < F.col("start")).alias("before"))
           .filter(F.col("now") != F.col("before")))
    entry = lambda n, sign: F.struct(F.col(n).alias("occurrences"), F.lit(sign).alias("n"))
    rows = per.select("event_type", F.explode(F.array(entry("now", 1), entry("before", -1))).alias("e")).filter("e.occurrences > 0")
    return rows.groupBy("event_type", "e.occurrences").agg(F.sum("e.n").alias("contained")).filter("contained <> 0")


def _first_positions(log: DataFrame, starts: DataFrame | None) -> DataFrame:
    return _started(log, starts).groupBy("trace_id", "start", "event_type").agg(F.min("position").alias("at"))


def unordered_u(log: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Traces that contain a type."""
    return (_first_positions(log, starts).filter(F.col("at") >= F.col("start"))
            .groupBy("event_type").agg(F.count("*").alias("count")))


def unordered_i(log: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Traces that contain both types, x < y."""
    first = _first_positions(log, starts)
    x = first.select("trace_id", "start", F.col("event_type").alias("x"), F.col("at").alias("_x"))
    y = first.select("trace_id", F.col("event_type").alias("y"), F.col("at").alias("_y"))
    return (x.join(y, "trace_id").filter((F.col("x") < F.col("y")) & (F.greatest("_x", "_y") >= F.col("start")))
            .groupBy("x", "y").agg(F.count("*").alias("count")))


#: Rule names.
ORDER_RULES = ("precedence", "alternate-precedence", "chain-precedence", "response", "alternate-response", "chain-response")


def order_state(log: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """All six ordered rules. Alternate and chain counts are the same in both directions and computed once.

    Each event stands once for every other type of its trace, and that one frame serves both ways: as A, with the next B; as
    B, with the first A. One shuffle by trace; what follows is sums.
    """
    whole = Window.partitionBy("trace_id", "other")
    first = F.min(F.when(F.col("event_type") == F.col("other"), F.col("position"))).over(whole)
    seen = _started(with_next_other(log).withColumn("_first", first).filter("event_type <> other"), starts)
    gaps = (seen.groupBy("trace_id", "start", "event_type", "other", F.col("nxt.position").alias("b"))
            .agg(F.count("*").alias("r"), F.max("position").alias("a"), F.count_if((F.col("_first") < F.col("position")) & (F.col("position") >= F.col("start"))).alias("after")))
    new = F.coalesce(F.col("b") >= F.col("start"), F.lit(False))
    per = gaps.groupBy("event_type", "other").agg(
        F.sum(F.when(new, F.col("r")).otherwise(0)).alias("response"), F.count_if(new).alias("alternate"),
        F.count_if(new & (F.col("a") == F.col("b") - 1)).alias("chain"), F.sum("after").alias("precedence"))
    entry = lambda rule, a, b, n: F.struct(F.lit(rule).alias("rule"), F.col(a).alias("eventA"), F.col(b).alias("eventB"), F.col(n).alias("occurrences"))
    rows = [entry(rule, "event_type", "other", n) for rule, n in (("response", "response"), ("alternate-response", "alternate"), ("alternate-precedence", "alternate"), ("chain-response", "chain"), ("chain-precedence", "chain"))]
    return per.select(F.inline(F.array(*rows, entry("precedence", "other", "event_type", "precedence")))).filter("occurrences > 0")


def merge_state(old: DataFrame, change: DataFrame, value: str) -> DataFrame:
    """Adds a change to a state; rows that come to 0 go."""
    keys = [c for c in old.columns if c != value]
    return old.unionByName(change).groupBy(*keys).agg(F.sum(value).alias(value)).filter(F.col(value) != 0)


def activity_matrix(log: DataFrame) -> DataFrame:
    """All ordered pairs of types, equal ones too. Types are few: the size is that of the result."""
    kinds = log.select("event_type").distinct()
    return kinds.select(F.col("event_type").alias("eventA")).crossJoin(kinds.select(F.col("event_type").alias("eventB")))


def negatives(matrix: DataFrame, order: DataFrame) -> DataFrame:
    """Pairs of different types without a response."""
    positive = order.filter("rule = 'response' AND occurrences > 0").select("eventA", "eventB")
    return matrix.filter("eventA <> eventB").join(positive, ["eventA", "eventB"], "left_anti")
