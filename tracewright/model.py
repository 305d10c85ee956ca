"""Schemas of the event log and of the stored tables."""
from pyspark.sql import types as T


def _s(*cols):
    return T.StructType([T.StructField(n, t) for n, t in cols])


_str, _int, _long, _ts = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampNTZType()

EVENT = _s(("trace_id", _str), ("event_type", _str), ("position", _int), ("ts", _ts))
DETAILED = _s(("trace_id", _str), ("event_type", _str), ("position", _int), ("ts", _ts),
              ("start_ts", _ts), ("waiting_time", _long), ("resource", _str))
PAIR = _s(("eventA", _str), ("eventB", _str), ("trace_id", _str), ("timeA", _ts), ("timeB", _ts),
          ("positionA", _int), ("positionB", _int))
LAST_CHECKED = _s(("eventA", _str), ("eventB", _str), ("trace_id", _str), ("timestamp", _ts))
COUNT = _s(("eventA", _str), ("eventB", _str), ("sum_duration", _long), ("count", _long),
           ("min_duration", _long), ("max_duration", _long), ("sum_squares", T.DoubleType()))
STREAM_MESSAGE = _s(("trace", _str), ("event_type", _str), ("timestamp", T.TimestampType()), ("position", _int))
POSITION_STATE = _s(("rule", _str), ("event_type", _str), ("occurrences", _long))
EXISTENCE_STATE = _s(("event_type", _str), ("occurrences", _long), ("contained", _long))
UNORDERED_U = _s(("event_type", _str), ("count", _long))
UNORDERED_I = _s(("x", _str), ("y", _str), ("count", _long))
ORDER_STATE = _s(("rule", _str), ("eventA", _str), ("eventB", _str), ("occurrences", _long))
NEGATIVE = _s(("eventA", _str), ("eventB", _str))
MINED = _s(("trace_id", _str), ("mined", _int))

CODECS = ("snappy", "uncompressed", "lz4", "zstd", "gzip")
MODES = ("positions", "timestamps")
