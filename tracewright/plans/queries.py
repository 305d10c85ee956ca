"""Registered queries over the driver's tables, each with SQL for DuckDB where SQL expresses it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import model
from tracewright.functions import millis
from tracewright.operators import declare, durations, indices, pairs
from tracewright.plans.indexing import META, NESTED_COUNT, Metadata, index_batch, index_schema, mine_constraints, waiting_columns
from tracewright.sources.generator import generate
from tracewright.sources.readers import decode_messages, event_log, messages, parse_with_timestamp, read_log, replay, stream_source
from tracewright.sources.store import TableStore, shared_folder
from tracewright.streaming.engine import drop_late, read_stream, run_stream, stream_metadata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CUT = "2024-01-16 00:00:00"

_E = """e AS (SELECT CAST(user_id AS VARCHAR) trace_id, event_type, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) pos,
 'r' || CAST(event_id % 7 AS VARCHAR) resource FROM events)"""


def _pairs_sql(days: int, name: str = "p", src: str = "e") -> str:
    return f"""{name}b AS (SELECT *, lag(pos) OVER (PARTITION BY trace_id, event_type ORDER BY pos) pb FROM {src}),
{name} AS (SELECT a.event_type ea, b.event_type eb, b.trace_id, min(a.ts) ta, b.ts tb, min(a.pos) pa, b.pos pb FROM {name}b b JOIN {src} a
 ON a.trace_id = b.trace_id AND a.pos < b.pos AND (b.pb IS NULL OR a.pos > b.pb OR (a.pos = b.pb AND a.event_type = b.event_type))
 AND (epoch_us(b.ts) // 1000) - (epoch_us(a.ts) // 1000) <= CAST({days} AS BIGINT) * 86400000 GROUP BY a.event_type, b.event_type, b.trace_id, b.ts, b.pos)"""


_COUNTS = """SELECT ea AS "eventA", eb AS "eventB", CAST(sum(d) AS BIGINT) AS sum_duration, count(*) AS "count", min(d) AS min_duration, max(d) AS max_duration,
 CAST(sum(CAST(d AS DOUBLE) * d) AS DOUBLE) AS sum_squares FROM (SELECT *, ((epoch_us(tb) // 1000) - (epoch_us(ta) // 1000)) // 1000 d FROM {src}) GROUP BY ea, eb"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark.read.parquet(f"{d}/events.parquet"), "user_id", "event_type", "ts", "event_id")


def _resources(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/events.parquet").withColumn("resource", F.concat(F.lit("r"), (F.col("event_id") % 7).cast("string")))
    return event_log(t, "user_id", "event_type", "ts", "event_id", ("resource",))


def _add(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql




def _q(name: str, op: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    _add(name, lambda s, d: op(_log(s, d)), sql)


_q("event_log", lambda e: e, f"WITH {_E} SELECT trace_id, event_type, pos AS position, ts FROM e")
_q("trace_lengths", indices.trace_lengths, f"WITH {_E} SELECT trace_id, count(*) AS n FROM e GROUP BY 1")
_q("event_type_counts", indices.event_type_counts, "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
_q("single_index", lambda e: indices.single_index(e).select("trace_id", "event_type", F.posexplode("occurrences").alias("idx", "o")).select("trace_id", "event_type", "idx", "o.position", "o.ts"),
   f"WITH {_E} SELECT trace_id, event_type, CAST(row_number() OVER (PARTITION BY trace_id, event_type ORDER BY pos) - 1 AS INTEGER) AS idx, pos AS position, ts FROM e")
_q("single_index_by_type", lambda e: indices.single_index_by_type(e).select("event_type", "trace_id", F.posexplode("occurrences").alias("idx", "o")).select("event_type", "trace_id", "idx", "o.position", "o.ts"),
   f"WITH {_E} SELECT event_type, trace_id, CAST(row_number() OVER (PARTITION BY event_type, trace_id ORDER BY pos) - 1 AS INTEGER) AS idx, pos AS position, ts FROM e")
_POS = 'SELECT ea AS "eventA", eb AS "eventB", trace_id, pa AS "positionA", pb AS "positionB" FROM p'
for _d in (1, 2, 5):
    _q(f"pairs_lookback_{_d}d", lambda e, d=_d: pairs.extract_pairs(e, d).select("eventA", "eventB", "trace_id", "positionA", "positionB"), f"WITH {_E}, {_pairs_sql(_d)} {_POS}")
_q("pairs_positions", lambda e: pairs.extract_pairs(e, 30).select("eventA", "eventB", "trace_id", "positionA", "positionB"), f"WITH {_E}, {_pairs_sql(30)} {_POS}")
_q("pairs_timestamps", lambda e: pairs.extract_pairs(e, 2).select("eventA", "eventB", "trace_id", F.col("timeA").alias("timestampA"), F.col("timeB").alias("timestampB")),
   f'WITH {_E}, {_pairs_sql(2)} SELECT ea AS "eventA", eb AS "eventB", trace_id, ta AS "timestampA", tb AS "timestampB" FROM p')
_q("pairs_same_type", lambda e: pairs.extract_pairs(e, 5).filter("eventA = eventB").select("eventA", "eventB", "trace_id", "positionA", "positionB"), f"WITH {_E}, {_pairs_sql(5)} {_POS} WHERE ea = eb")
# the driver's log has no two events of a trace at one instant, so both policies give the same pairs
_q("pairs_compat_ties", lambda e: pairs.extract_pairs(e, 2, compat_ties=True).select("eventA", "eventB", "trace_id", "positionA", "positionB"), f"WITH {_E}, {_pairs_sql(2)} {_POS}")
_LAST = 'SELECT ea AS "eventA", eb AS "eventB", trace_id, max(tb) AS "timestamp" FROM {src} GROUP BY 1, 2, 3'
_q("last_checked", lambda e: pairs.last_checked(pairs.extract_pairs(e, 2)), f"WITH {_E}, {_pairs_sql(2)} {_LAST.format(src='p')}")
_q("count_table", lambda e: pairs.pair_counts(pairs.extract_pairs(e, 2)), f"WITH {_E}, {_pairs_sql(2)} {_COUNTS.format(src='p')}")
_q("count_table_nested", lambda e: pairs.nest_counts(pairs.pair_counts(pairs.extract_pairs(e, 5))).select("eventA", F.inline("times")), f"WITH {_E}, {_pairs_sql(5)} {_COUNTS.format(src='p')}")


def _parts(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(CUT).cast("timestamp_ntz")
    return e.filter(F.col("ts") < cut), e.filter(F.col("ts") >= cut)


def _starts(e: DataFrame) -> DataFrame:
    return _parts(e)[1].groupBy("trace_id").agg(F.min("position").alias("start"))


_CUT_SQL = f"old AS (SELECT * FROM e WHERE ts < TIMESTAMP '{CUT}'), st AS (SELECT trace_id, min(pos) start FROM e WHERE ts >= TIMESTAMP '{CUT}' GROUP BY 1)"
_NEW = "n AS (SELECT p.* FROM p JOIN st USING (trace_id) WHERE p.pb >= start)"
_q("incremental_pairs", lambda e: pairs.extract_pairs(e, 5, _starts(e)).select("eventA", "eventB", "trace_id", "positionA", "positionB"), f"WITH {_E}, {_CUT_SQL}, {_pairs_sql(5)}, {_NEW} {_POS.replace('FROM p', 'FROM n')}")
_q("incremental_counts_merged", lambda e: pairs.merge_counts(pairs.pair_counts(pairs.extract_pairs(_parts(e)[0], 5)), pairs.pair_counts(pairs.extract_pairs(e, 5, _starts(e)))),
   f"WITH {_E}, {_pairs_sql(5)} {_COUNTS.format(src='p')}")
_q("last_checked_evicted", lambda e: pairs.merge_last_checked(pairs.last_checked(pairs.extract_pairs(_parts(e)[0], 5)), pairs.last_checked(pairs.extract_pairs(e, 5, _starts(e))), CUT, 5),
   f"WITH {_E}, {_CUT_SQL}, {_pairs_sql(5)}, {_NEW}, {_pairs_sql(5, 'o', 'old')}, l AS (SELECT * FROM (SELECT ea, eb, trace_id, max(tb) m FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1, 2, 3)) "
   f"""SELECT ea AS "eventA", eb AS "eventB", trace_id, m AS "timestamp" FROM l WHERE (epoch_us(TIMESTAMP '{CUT}') // 1000) - (epoch_us(m) // 1000) < CAST(5 AS BIGINT) * 86400000""")


def _repair(e: DataFrame) -> DataFrame:
    old, new = _parts(e)
    first = _starts(e)
    batch = new.join(first, "trace_id").withColumn("position", F.col("position") - F.col("start")).drop("start")
    return indices.repair_positions(batch, indices.last_positions(old)).select("trace_id", "event_type", "position", "ts")


_q("position_repair", _repair, f"WITH {_E} SELECT trace_id, event_type, pos AS position, ts FROM e WHERE ts >= TIMESTAMP '{CUT}'")
_q("metadata_summary", lambda e: indices.metadata_summary(e, pairs.extract_pairs(e, 2)),
   f"WITH {_E}, {_pairs_sql(2)} SELECT count(DISTINCT trace_id) AS traces, count(*) AS events, min(ts) AS start_ts, max(ts) AS last_ts, (SELECT count(*) FROM p) AS pairs FROM e")
_q("changed_traces", lambda e: indices.changed_traces(e, CUT), f"""WITH {_E} SELECT trace_id, min(pos) AS start, max(pos) AS "end" FROM e WHERE ts > TIMESTAMP '{CUT}' GROUP BY 1""")
_q("activity_matrix", declare.activity_matrix, 'WITH k AS (SELECT DISTINCT event_type t FROM events) SELECT a.t AS "eventA", b.t AS "eventB" FROM k a, k b')

_FL = """SELECT 'first' AS rule, event_type, count(*) AS occurrences FROM e WHERE pos = 0 GROUP BY 2
UNION ALL SELECT 'last', event_type, count(*) FROM (SELECT *, max(pos) OVER (PARTITION BY trace_id) m FROM e) WHERE pos = m AND pos > 0 GROUP BY 2"""
_q("declare_first_last", declare.first_last, f"WITH {_E} {_FL}")
_q("declare_exactly_n", declare.exactly_n, f"WITH {_E} SELECT event_type, occurrences, count(*) AS contained FROM (SELECT trace_id, event_type, count(*) occurrences FROM e GROUP BY 1, 2) GROUP BY 1, 2")
_q("declare_u", declare.unordered_u, f'WITH {_E} SELECT event_type, count(DISTINCT trace_id) AS "count" FROM e GROUP BY 1')
_q("declare_i", declare.unordered_i, f'WITH {_E}, k AS (SELECT DISTINCT trace_id, event_type FROM e) SELECT a.event_type AS x, b.event_type AS y, count(*) AS "count" FROM k a JOIN k b ON a.trace_id = b.trace_id AND a.event_type < b.event_type GROUP BY 1, 2')
_ORDER = """kk AS (SELECT DISTINCT event_type t FROM e),
g AS (SELECT e.trace_id, e.event_type eb, e.pos b, kk.t ea, coalesce((SELECT max(x.pos) FROM e x WHERE x.trace_id = e.trace_id AND x.event_type = e.event_type AND x.pos < e.pos), 0) prev FROM e JOIN kk ON kk.t <> e.event_type),
h AS (SELECT g.ea, g.eb, g.trace_id, g.b, max(a.pos) la, count(*) FILTER (a.pos >= g.prev) r, any_value(prev) prev FROM g JOIN e a ON a.trace_id = g.trace_id AND a.event_type = g.ea AND a.pos < g.b {where} GROUP BY 1, 2, 3, 4),
o AS (SELECT 'precedence' AS rule, ea, eb, count(*) n FROM h GROUP BY 2, 3
UNION ALL SELECT unnest(['alternate-precedence', 'alternate-response']), ea, eb, count(*) FROM h WHERE la >= prev GROUP BY 1, 2, 3
UNION ALL SELECT unnest(['chain-precedence', 'chain-response']), ea, eb, count(*) FROM h WHERE la = b - 1 GROUP BY 1, 2, 3
UNION ALL SELECT 'response', ea, eb, CAST(sum(r) AS BIGINT) FROM h GROUP BY 2, 3 HAVING sum(r) > 0)"""
_OSEL = 'SELECT rule, ea AS "eventA", eb AS "eventB", n AS occurrences FROM o'
_order = f"WITH {_E}, {_ORDER.format(where='')} "
_q("declare_order_state", declare.order_state, _order + _OSEL)
for _r in declare.ORDER_RULES:
    _q(f"declare_{_r.replace('-', '_')}", lambda e, r=_r: declare.order_state(e).filter(F.col("rule") == r), _order + _OSEL + f" WHERE rule = '{_r}'")
_q("declare_negatives", lambda e: declare.negatives(declare.activity_matrix(e), declare.order_state(e)),
   _order + "SELECT a.t AS \"eventA\", b.t AS \"eventB\" FROM kk a JOIN kk b ON a.t <> b.t WHERE NOT EXISTS (SELECT 1 FROM o WHERE rule = 'response' AND ea = a.t AND eb = b.t)")


def _delta(e: DataFrame) -> DataFrame:
    starts = _starts(e)
    return declare.order_state(e.join(starts.select("trace_id"), "trace_id", "left_semi"), starts)


_q("declare_incremental_delta", _delta, f"WITH {_E}, {_CUT_SQL}, {_ORDER.format(where='JOIN st ON st.trace_id = g.trace_id AND g.b >= st.start')} {_OSEL}")
_DFG = "d AS (SELECT event_type a, lead(event_type) OVER (PARTITION BY trace_id ORDER BY pos) b FROM e), f AS (SELECT a, b, count(*) n FROM d WHERE b IS NOT NULL GROUP BY 1, 2)"
_LOOPS = "sl AS (SELECT DISTINCT a, b FROM (SELECT lag(event_type) OVER w a, event_type b, lead(event_type) OVER w c FROM e WINDOW w AS (PARTITION BY trace_id ORDER BY pos)) WHERE a = c AND a <> b)"
_CONC = "cc AS (SELECT f.a, f.b FROM f JOIN f r ON f.a = r.b AND f.b = r.a WHERE f.a <> f.b AND abs(f.n - r.n) < f.n + r.n AND NOT EXISTS (SELECT 1 FROM sl WHERE (sl.a = f.a AND sl.b = f.b) OR (sl.a = f.b AND sl.b = f.a)))"
_q("directly_follows", indices.directly_follows, f'WITH {_E}, {_DFG} SELECT a AS "eventA", b AS "eventB", n FROM f')
_q("short_loops", durations.short_loops, f'WITH {_E}, {_LOOPS} SELECT a AS "eventA", b AS "eventB" FROM sl')
_q("concurrent_pairs", durations.concurrent_pairs, f'WITH {_E}, {_DFG}, {_LOOPS}, {_CONC} SELECT a AS "eventA", b AS "eventB" FROM cc')
_EN = """en AS (SELECT trace_id, event_type, pos, ts, resource, last_value(own IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY pos) enabled_ts FROM (
 SELECT s.*, CASE WHEN pts IS NULL THEN CASE WHEN date_trunc('hour', ts) = ts THEN ts - INTERVAL 1 HOUR ELSE date_trunc('hour', ts) END WHEN cc.a IS NULL THEN pts END own
 FROM (SELECT *, lag(event_type) OVER w pt, lag(ts) OVER w pts FROM e WINDOW w AS (PARTITION BY trace_id ORDER BY pos)) s LEFT JOIN cc ON cc.a = s.pt AND cc.b = s.event_type))"""
_add("enablement_time", lambda s, d: durations.enablement(_log(s, d)).select("trace_id", "position", "enabled_ts"),
     f"WITH {_E}, {_DFG}, {_LOOPS}, {_CONC}, {_EN} SELECT trace_id, pos AS position, enabled_ts FROM en")
_add("start_time_resource", lambda s, d: waiting_columns(_resources(s, d)).select("trace_id", "position", "resource", "start_ts", "waiting_time"),
     f"WITH {_E}, {_DFG}, {_LOOPS}, {_CONC}, {_EN}, fr AS (SELECT *, max(ts) OVER (PARTITION BY resource ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) free FROM en) "
     "SELECT trace_id, pos AS position, resource, greatest(enabled_ts, free) AS start_ts, ((epoch_us(greatest(enabled_ts, free)) // 1000) - (epoch_us(enabled_ts) // 1000)) // 1000 AS waiting_time FROM fr")
_q("single_index_full", lambda e: _full(e), f"WITH {_E} SELECT trace_id, event_type, pos AS position FROM e WHERE ts >= TIMESTAMP '{CUT}'")


def _full(e: DataFrame) -> DataFrame:
    old, new = _parts(e)
    batch = new.join(_starts(e), "trace_id").withColumn("position", F.col("position") - F.col("start")).drop("start")
    return indices.single_index_full(batch, indices.last_positions(old)).select("trace_id", "event_type", F.explode("occurrences").alias("o")).select("trace_id", "event_type", "o.position")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """Writes the log as text lines, one a trace, and parses them."""
    e = _log(spark, d)
    item = F.concat_ws("/delab/", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    lines = e.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("position", item.alias("t")))).alias("l"))
    return parse_with_timestamp(lines.select(F.concat_ws("::", "trace_id", F.array_join("l.t", ",")).alias("value")))


_add("parse_with_timestamp", _parsed, f"WITH {_E} SELECT trace_id, event_type, pos AS position, date_trunc('second', ts) AS ts FROM e")
_add("conversation_log", lambda s, d: event_log(s.read.parquet(f"{d}/conversations.parquet").withColumn("ts", F.timestamp_seconds("turn")), "conv_id", "role", "ts", "turn").select("trace_id", "event_type", "position"),
     "SELECT CAST(conv_id AS VARCHAR) AS trace_id, role AS event_type, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position FROM conversations")
_LI = "e AS (SELECT CAST(l_orderkey AS VARCHAR) trace_id, l_returnflag || l_linestatus event_type, CAST(l_shipdate AS TIMESTAMP) ts, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_returnflag || l_linestatus) - 1 AS INTEGER) pos FROM lineitem)"
_add("lineitem_pairs", lambda s, d: pairs.pair_counts(pairs.extract_pairs(event_log(s.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", F.concat("l_returnflag", "l_linestatus"), "l_shipdate", "l_linenumber"), 60)),
     f"WITH {_LI}, {_pairs_sql(60)} {_COUNTS.format(src='p')}")


# --- logs with phases, so some types never follow others, and with short traces, so types are concurrent ----------------

_PH = _E.replace("e AS (", "e0 AS (", 1) + ", e AS (SELECT trace_id, event_type || '_' || CAST(least(pos // 20, 3) AS VARCHAR) event_type, pos, ts FROM e0)"
_SP = _E.replace("e AS (", "e0 AS (", 1) + ", e AS (SELECT trace_id || '-' || CAST(pos // 2 AS VARCHAR) trace_id, event_type, CAST(pos % 2 AS INTEGER) pos, ts, resource FROM e0)"


def _phases(spark: SparkSession, d: str) -> DataFrame:
    phase = F.least(F.floor(F.col("position") / 20), F.lit(3)).cast("string")
    return _log(spark, d).withColumn("event_type", F.concat_ws("_", "event_type", phase))


def _short(spark: SparkSession, d: str) -> DataFrame:
    part = F.floor(F.col("position") / 2).cast("string")
    return _resources(spark, d).withColumn("trace_id", F.concat_ws("-", "trace_id", part)).withColumn("position", (F.col("position") % 2).cast("int"))


_ph_order = f"WITH {_PH}, {_ORDER.format(where='')} "
_NEG = "SELECT a.t AS \"eventA\", b.t AS \"eventB\" FROM kk a JOIN kk b ON a.t <> b.t WHERE NOT EXISTS (SELECT 1 FROM o WHERE rule = 'response' AND ea = a.t AND eb = b.t)"
_add("declare_negatives_phases", lambda s, d: declare.negatives(declare.activity_matrix(_phases(s, d)), declare.order_state(_phases(s, d))), _ph_order + _NEG)
_add("declare_order_phases", lambda s, d: declare.order_state(_phases(s, d)), _ph_order + _OSEL)
_add("concurrent_pairs_short", lambda s, d: durations.concurrent_pairs(_short(s, d)), f'WITH {_SP}, {_DFG}, {_LOOPS}, {_CONC} SELECT a AS "eventA", b AS "eventB" FROM cc')
_add("enablement_time_concurrent", lambda s, d: durations.enablement(_short(s, d)).select("trace_id", "position", "enabled_ts"),
     f"WITH {_SP}, {_DFG}, {_LOOPS}, {_CONC}, {_EN} SELECT trace_id, pos AS position, enabled_ts FROM en")
_ST_SQL = ("fr AS (SELECT *, max(ts) OVER (PARTITION BY resource ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) free FROM en) "
           "SELECT trace_id, pos AS position, resource, greatest(enabled_ts, free) AS start_ts, ((epoch_us(greatest(enabled_ts, free)) // 1000) - (epoch_us(enabled_ts) // 1000)) // 1000 AS waiting_time{more} FROM fr")
_add("start_time_concurrent", lambda s, d: waiting_columns(_short(s, d)).select("trace_id", "position", "resource", "start_ts", "waiting_time"),
     f"WITH {_SP}, {_DFG}, {_LOOPS}, {_CONC}, {_EN}, {_ST_SQL.format(more='')}")


# --- readers over the whole events table, written in their format ---------------------------------------------------------


def _lines(e: DataFrame, item: Column, sep: str) -> Column:
    return e.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("position", item.alias("t")))).alias("l")).select("trace_id", F.array_join("l.t", sep).alias("body"))


def _parsed_detailed(spark: SparkSession, d: str) -> DataFrame:
    item = F.concat_ws("/delab/", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "resource")
    path = shared_folder(spark, "lines") + "/log.withTimestamp"
    _lines(_resources(spark, d), item, ",").select(F.concat_ws("::", "trace_id", "body").alias("value")).write.text(path)
    return read_log(spark, path, detailed=True)


def _parsed_xes(spark: SparkSession, d: str) -> DataFrame:
    text = lambda key, c: F.concat(F.lit(f'<string key="{key}" value="'), c, F.lit('"/>'))
    date = F.concat(F.lit('<date key="time:timestamp" value="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit('+00:00"/>'))
    item = F.concat(F.lit("<event>"), text("concept:name", F.col("event_type")), text("org:resource", F.col("resource")), date, F.lit("</event>"))
    e, path = _resources(spark, d), shared_folder(spark, "lines") + "/log.xes"
    documents = max(1, e.select("trace_id").distinct().count() // 50)  # about 50 traces in a file
    traces = _lines(e, item, "").select(F.pmod(F.xxhash64("trace_id"), F.lit(documents)).alias("file"), F.concat(F.lit("<trace>"), text("concept:name", F.col("trace_id")), "body", F.lit("</trace>")).alias("t"))
    whole = traces.groupBy("file").agg(F.concat(F.lit("<log>"), F.array_join(F.collect_list("t"), ""), F.lit("</log>")).alias("value"))
    whole.write.partitionBy("file").text(path)
    return read_log(spark, path, detailed=True)


_PARSED = f"WITH {_E} SELECT trace_id, event_type, pos AS position, date_trunc('second', ts) AS ts, resource FROM e"
_add("parse_detailed", _parsed_detailed, _PARSED)
_add("parse_xes", _parsed_xes, _PARSED)
_q("decode_messages", lambda e: decode_messages(messages(e)).select(F.col("trace").alias("trace_id"), "event_type", "position", F.col("timestamp").cast("timestamp_ntz").alias("ts")),
   f"WITH {_E} SELECT trace_id, event_type, pos AS position, ts FROM e")


# --- a store that took the log in two batches, constraints that were mined after each, and a stream that replays the log ---

_MADE: dict[tuple[str, str, str], TableStore] = {}


def _made(name: str, spark: SparkSession, d: str, make: Callable[[TableStore], None]) -> TableStore:
    """A store is filled once for each session and folder; its queries read it."""
    key = (spark.sparkContext.applicationId, name, d)
    if key not in _MADE:
        store = TableStore(spark, shared_folder(spark, name), "log")
        make(store)
        _MADE[key] = store
    return _MADE[key]


def _batches(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    old, new = _parts(e)
    first = new.groupBy("trace_id").agg(F.min("position").alias("_first"))
    return old, new.join(first, "trace_id").withColumn("position", (F.col("position") - F.col("_first")).cast("int")).drop("_first")


def _store(spark: SparkSession, d: str) -> TableStore:
    def make(store: TableStore) -> None:
        log = waiting_columns(_resources(spark, d))
        for part in _batches(log):
            index_batch(store, part, Metadata("log", lookback=5, filename="events"), detailed=True)

    return _made("store", spark, d, make)


def _mined(spark: SparkSession, d: str) -> TableStore:
    def make(store: TableStore) -> None:
        for part in _batches(_phases(spark, d)):
            index_batch(store, part, Metadata("log", lookback=5))
            mine_constraints(store)

    return _made("mined", spark, d, make)


def _streamed(spark: SparkSession, d: str) -> TableStore:
    def make(store: TableStore) -> None:
        folder = store.path("in")
        for _ in replay(_log(spark, d), folder):
            for q in run_stream(store, decode_messages(stream_source(spark, "text", path=folder)), 5, available_now=True):
                q.awaitTermination()

    return _made("stream", spark, d, make)


def _stored(name: str, table: str, schema, sql: str, view: Callable[[DataFrame], DataFrame] = lambda x: x, of: Callable[[SparkSession, str], TableStore] = _store) -> None:
    _add(name, lambda s, d: view(of(s, d).read(table, schema)), sql)


_EVENTS = f"WITH {_E} SELECT trace_id, event_type, pos AS position, ts FROM e"
_stored("store_sequence", "sequence", model.EVENT, _EVENTS)
_stored("store_single", "single", model.EVENT, _EVENTS)
_stored("store_detailed", "detailed", model.DETAILED, f"WITH {_E}, {_DFG}, {_LOOPS}, {_CONC}, {_EN}, {_ST_SQL.format(more=', event_type, ts')}")
_stored("store_index", "index", index_schema("positions"), f"WITH {_E}, {_pairs_sql(5)} {_POS}")
_stored("store_count", "count", NESTED_COUNT, f"WITH {_E}, {_pairs_sql(5)} {_COUNTS.format(src='p')}", lambda x: x.select("eventA", F.inline("times")))
_stored("store_last_checked", "last_checked", model.LAST_CHECKED, SQL["last_checked_evicted"].replace(f"(epoch_us(TIMESTAMP '{CUT}') // 1000)", f"((SELECT epoch_us(min(ts)) FROM e WHERE ts >= TIMESTAMP '{CUT}') // 1000)"))
_stored("store_metadata", "metadata", META, f"WITH {_E}, {_pairs_sql(5)} SELECT 'log' AS log_name, 'positions' AS mode, 'snappy' AS compression, CAST(5 AS BIGINT) AS lookback, count(DISTINCT trace_id) AS traces, count(*) AS events, "
        "(SELECT count(*) FROM p) AS pairs, true AS has_previous_stored, 'events' AS filename, min(ts) AS start_ts, max(ts) AS last_ts FROM e",
        lambda x: x.select("log_name", "mode", "compression", "lookback", "traces", "events", "pairs", "has_previous_stored", "filename", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_ts", "last_ts"))))
for _name, _schema, _sql in (
        ("position", model.POSITION_STATE, f"WITH {_PH} {_FL}"),
        ("existence", model.EXISTENCE_STATE, SQL["declare_exactly_n"].replace(_E, _PH)), ("unordered_u", model.UNORDERED_U, SQL["declare_u"].replace(_E, _PH)),
        ("unordered_i", model.UNORDERED_I, SQL["declare_i"].replace(_E, _PH)), ("order", model.ORDER_STATE, _ph_order + _OSEL), ("negatives", model.NEGATIVE, _ph_order + _NEG)):
    _stored(f"mined_{_name}", f"declare_{_name}", _schema, _sql, of=_mined)
_stored("mined_positions", "declare_mined", model.MINED, f"WITH {_PH} SELECT trace_id, CAST(max(pos) + 1 AS INTEGER) AS mined FROM e GROUP BY 1", of=_mined)
_add("stream_sequence", lambda s, d: read_stream(_streamed(s, d), "sequence", model.EVENT), _EVENTS)
_add("stream_single", lambda s, d: read_stream(_streamed(s, d), "single", model.EVENT), _EVENTS)
_add("stream_pairs", lambda s, d: read_stream(_streamed(s, d), "index", model.PAIR).select("eventA", "eventB", "trace_id", "positionA", "positionB"), f"WITH {_E}, {_pairs_sql(5)} {_POS}")
_add("stream_counts", lambda s, d: read_stream(_streamed(s, d), "count", model.COUNT), f"WITH {_E}, {_pairs_sql(5)} {_COUNTS.format(src='p')}")
_add("stream_metadata", lambda s, d: stream_metadata(_streamed(s, d)), f"WITH {_E}, {_pairs_sql(5)} SELECT count(DISTINCT trace_id) AS traces, count(*) AS events, (SELECT count(*) FROM p) AS pairs FROM e")


def _not_late(spark: SparkSession, d: str) -> DataFrame:
    """Even event numbers of each trace in one batch, odd ones in the next: of these only what is later than all before stays."""
    root, log = shared_folder(spark, "late"), _log(spark, d)
    for odd in (0, 1):
        messages(log.filter(F.col("position") % 2 == odd)).write.mode("append").text(f"{root}/in")
        kept = drop_late(decode_messages(stream_source(spark, "text", path=f"{root}/in")))
        w = kept.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        w.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("trace string, event_type string, timestamp timestamp, position int").parquet(f"{root}/out")
    return out.select(F.col("trace").alias("trace_id"), "event_type", "position", F.col("timestamp").cast("timestamp_ntz").alias("ts"))


_add("stream_not_late", _not_late, f"WITH {_E}, m AS (SELECT trace_id, max(ts) m FROM e WHERE pos % 2 = 0 GROUP BY 1) SELECT trace_id, event_type, pos AS position, ts FROM e JOIN m USING (trace_id) WHERE pos % 2 = 0 OR ts > m")


def _synthetic(spark: SparkSession, d: str) -> DataFrame:
    return generate(spark, 1000, 20).groupBy("trace_id").agg(F.count("*").alias("n"), F.max(millis(F.col("ts"))).alias("last_ms"))


_add("synthetic_trace_stats", _synthetic)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["count_table"](spark, d)


__all__ = ["QUERIES", "SQL", "flagship"]
