"""Column expressions shared by the operators."""
from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ column (session time zone UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from ``a`` to ``b``; each side is cut to milliseconds first."""
    return F.floor((millis(b) - millis(a)) / 1000).cast("long")


def within_lookback(a: Column, b: Column, days: int) -> Column:
    """True where ``b`` is at most ``days`` after ``a`` (inclusive, exact milliseconds)."""
    return (millis(b) - millis(a)) <= F.lit(days * DAY_MS)


def floor_hour_before(ts: Column) -> Column:
    """The full hour strictly before ``ts`` (an exact hour goes one hour back)."""
    hour = F.date_trunc("HOUR", ts).cast("timestamp_ntz")
    return F.when(hour == ts, hour - F.expr("INTERVAL 1 HOUR")).otherwise(hour)
