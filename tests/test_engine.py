"""Golden numbers, equivalences and plan checks of the event-log engine."""
import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright import model
from tracewright.operators import declare, durations, indices, pairs
from tracewright.plans.indexing import NESTED_COUNT, Metadata, index_batch, index_schema, mine_constraints, read_metadata
from tracewright.plans.queries import QUERIES
from tracewright.sources.generator import generate
from tracewright.sources.readers import read_log, register_reader
from tracewright.sources.store import TableStore
from tracewright.streaming.engine import MetricsListener, drop_late, read_stream, run_stream, stream_metadata

T = lambda s: dt.datetime.strptime(s, "%Y-%m-%d %H:%M:%S")
#: The sample logs, and below the counts of their pairs and constraints.
LOG1 = {"0": [("a", "2020-08-15 12:56:42"), ("b", "2020-08-16 12:56:42"), ("a", "2020-08-19 12:56:42"), ("b", "2020-08-20 14:21:02")],
        "1": [("a", "2020-08-15 12:11:54"), ("c", "2020-08-16 12:11:54")], "2": [("c", "2020-08-15 12:31:04"), ("b", "2020-08-16 12:31:04"), ("a", "2020-08-18 12:31:04")]}
LOG2 = {"0": [("a", "2020-09-03 12:56:42"), ("b", "2020-09-05 12:56:42")], "1": [("a", "2020-08-19 12:11:54")], "2": [("c", "2020-09-07 12:31:04"), ("a", "2020-09-08 12:31:04")]}
TEST1 = LOG1 | {"1": [("b", "2020-08-15 12:11:54"), ("c", "2020-08-16 12:11:54")]}
TEST2 = {"0": LOG2["0"], "1": [("a", "2020-09-05 12:11:54")], "2": [("c", "2020-09-07 12:31:04"), ("b", "2020-09-08 12:31:04")],
         "3": [("c", "2020-09-07 12:31:04"), ("d", "2020-09-08 12:31:04"), ("a", "2020-09-09 12:31:04")]}


def frame(spark, log):
    return spark.createDataFrame([(t, k, i, T(ts)) for t, es in log.items() for i, (k, ts) in enumerate(es)], model.EVENT)


def joined(a, b):
    return {t: a.get(t, []) + b.get(t, []) for t in a | b}


def kinds(df):
    return Counter((r.eventA, r.eventB) for r in df.collect())


@pytest.mark.parametrize("days,want,last", [(2, {("a", "b"): 2, ("a", "c"): 1, ("b", "a"): 1, ("c", "b"): 1}, 4), (5, {("a", "a"): 1, ("a", "b"): 2, ("a", "c"): 1, ("b", "a"): 2, ("b", "b"): 1, ("c", "a"): 1, ("c", "b"): 1}, 8), (30, {("a", "a"): 1, ("a", "b"): 2, ("a", "c"): 1, ("b", "a"): 2, ("b", "b"): 1, ("c", "a"): 1, ("c", "b"): 1}, 8)])
def test_pairs_of_first_log(spark, days, want, last):
    p = pairs.extract_pairs(frame(spark, LOG1), days)
    assert kinds(p) == want and pairs.last_checked(p).count() == last


@pytest.mark.parametrize("days,want", [(10, {("a", "a"): 1, ("a", "b"): 1, ("c", "a"): 2}), (15, {("a", "a"): 2, ("a", "b"): 1, ("b", "a"): 1, ("c", "a"): 2}), (30, {("a", "a"): 3, ("a", "b"): 1, ("a", "c"): 1, ("b", "a"): 1, ("b", "b"): 1, ("b", "c"): 1, ("c", "a"): 2, ("c", "c"): 1})])
def test_new_pairs(spark, days, want):
    starts = spark.createDataFrame([(t, len(LOG1[t])) for t in LOG2], "trace_id string, start int")
    p = pairs.extract_pairs(frame(spark, joined(LOG1, LOG2)), days, starts)
    assert kinds(p) == want and pairs.last_checked(p).count() == sum(want.values())


def test_store_adds_up(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), "log")
    m = index_batch(store, frame(spark, LOG1), Metadata("log"))
    assert (m.pairs, m.traces, m.events) == (9, 3, 9)
    assert indices.single_index(frame(spark, LOG1)).count() == 7
    m = index_batch(store, frame(spark, LOG2), Metadata("log", lookback=3))
    assert (m.pairs, m.traces, m.events, m.lookback) == (20, 3, 14, 30)
    assert store.read("last_checked", model.LAST_CHECKED).count() == 14
    index = store.read("index", index_schema("positions"))
    assert kinds(index) == {("a", "a"): 4, ("a", "b"): 3, ("a", "c"): 2, ("b", "a"): 3, ("b", "b"): 2, ("b", "c"): 1, ("c", "a"): 3, ("c", "b"): 1, ("c", "c"): 1}
    whole = pairs.pair_counts(pairs.extract_pairs(frame(spark, joined(LOG1, LOG2)), 30))
    from tracewright.plans.indexing import _flat_counts
    assert sorted(map(tuple, _flat_counts(store).collect())) == sorted(map(tuple, whole.select(*model.COUNT.names).collect()))
    assert Counter(r.trace_id for r in store.read("sequence", model.EVENT).collect()) == {"0": 6, "1": 3, "2": 5}
    assert index_batch(store, frame(spark, LOG1).limit(0), Metadata("log")) == m
    store.delete_log()
    assert store.read("sequence", model.EVENT).count() == 0


def rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_constraints_add_up(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), "log")
    both = frame(spark, joined(TEST1, TEST2))
    index_batch(store, frame(spark, TEST1), Metadata("log"))
    mine_constraints(store)
    u = {r.event_type: r["count"] for r in store.read("declare_unordered_u", model.UNORDERED_U).collect()}
    assert u == {"a": 2, "b": 3, "c": 2}
    assert kinds(store.read("declare_negatives", model.NEGATIVE)) == {("a", "c"): 1}
    index_batch(store, frame(spark, TEST2), Metadata("log"))
    mine_constraints(store)
    for name, fn, schema in (("position", declare.first_last, model.POSITION_STATE), ("existence", declare.exactly_n, model.EXISTENCE_STATE),
                             ("unordered_u", declare.unordered_u, model.UNORDERED_U), ("unordered_i", declare.unordered_i, model.UNORDERED_I),
                             ("order", declare.order_state, model.ORDER_STATE)):
        assert rows(store.read(f"declare_{name}", schema)) == rows(fn(both)), name
    assert kinds(store.read("declare_negatives", model.NEGATIVE)) == {("a", "d"): 1, ("b", "d"): 1, ("d", "b"): 1, ("d", "c"): 1}
    got = {(r.eventA, r.eventB): r.occurrences for r in declare.order_state(both).filter("rule = 'chain-response'").collect()}
    assert got == {("a", "b"): 3, ("a", "c"): 1, ("b", "a"): 3, ("b", "c"): 1, ("c", "a"): 1, ("c", "b"): 2, ("c", "d"): 1, ("d", "a"): 1}
    assert {(r.rule, r.event_type): r.occurrences for r in declare.first_last(both).collect()} == {
        ("first", "a"): 1, ("first", "b"): 1, ("first", "c"): 2, ("last", "a"): 2, ("last", "b"): 2}
    assert read_metadata(store, Metadata("log")).last_declare_mined == "2020-09-09 12:31:04"


def random_log(seed, n=60, ties=False):
    rnd, start = random.Random(seed), dt.datetime(2021, 1, 1)
    out = []
    for t in range(n):
        at = start
        for i in range(rnd.randint(10, 60)):
            at += dt.timedelta(seconds=rnd.choice([0, 1]) if ties else rnd.randint(1, 40_000))
            out.append((str(t), rnd.choice("abcdefgh"), i, at))
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_pairs_equal_the_greedy_walk(spark, ties):
    data, ms = random_log(5, ties=ties), lambda x: int(x.timestamp() * 1000)
    by = {}
    for t, k, i, at in data:
        by.setdefault(t, []).append((k, i, ms(at)))
    want = sorted((t, *p) for t, es in by.items() for p in pairs.greedy_pairs(es, 2 * 86_400_000))
    got = pairs.extract_pairs(spark.createDataFrame(data, model.EVENT), 2, compat_ties=ties)
    assert sorted((r.trace_id, r.eventA, r.eventB, r.positionA, r.positionB) for r in got.collect()) == want


def test_batches_equal_one_run(spark):
    data = spark.createDataFrame(random_log(9), model.EVENT)
    cut = F.pmod(F.xxhash64("trace_id"), F.lit(9)).cast("int")
    starts = data.filter(F.col("position") >= cut).groupBy("trace_id").agg(F.min("position").alias("start"))
    old = pairs.extract_pairs(data.filter(F.col("position") < cut), 3)
    both = old.unionByName(pairs.extract_pairs(data, 3, starts))
    assert rows(both) == rows(pairs.extract_pairs(data, 3))
    for fn, value in ((declare.first_last, "occurrences"), (declare.exactly_n, "contained"), (declare.unordered_u, "count"),
                      (declare.unordered_i, "count"), (declare.order_state, "occurrences")):
        merged = declare.merge_state(fn(data.filter(F.col("position") < cut)), fn(data, starts), value)
        assert rows(merged) == rows(fn(data)), fn


def plan_of(df):
    import re

    return re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString())


def test_pairs_shuffle_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert len(plan_of(pairs.extract_pairs(frame(spark, LOG1), 30))) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_readers(spark, tmp_path):
    a = tmp_path / "my.log.withTimestamp"
    a.write_text("0::a/delab/2020-08-15 12:56:42/delab/r1,b/delab/2020-08-16 12:56:42/delab/r2\n1::c/delab/2020-08-15 01:00:00/delab/r1")
    log = read_log(spark, str(a), detailed=True)
    assert [(r.trace_id, r.event_type, r.position, r.resource) for r in log.orderBy("trace_id", "position").collect()] == [("0", "a", 0, "r1"), ("0", "b", 1, "r2"), ("1", "c", 0, "r1")]
    assert log.filter("ts IS NULL").count() == 0
    b = tmp_path / "x.txt"
    b.write_text("a,b,a\nc")
    assert rows(read_log(spark, str(b)).select("trace_id", "event_type", "position")) == [("a", "0", "0"), ("a", "2", "0"), ("b", "1", "0"), ("c", "0", "1")]
    x = tmp_path / "y.xes"
    x.write_text("""<?xml version="1.0"?><log><trace><string key="concept:name" value="t1"/>
<event><string key="concept:name" value="A"/><string key="org:resource" value="bo"/><date key="time:timestamp" value="2020-01-01T10:00:00.123+01:00"/></event>
<event><string key="concept:name" value="B"/><string key="org:resource" value="al"/><date key="time:timestamp" value="2020-01-01T11:00:00+01:00"/></event></trace></log>""")
    got = read_log(spark, str(x), detailed=True).orderBy("position").collect()
    assert [(r.trace_id, r.event_type, r.position, str(r.ts), r.resource) for r in got] == [("t1", "A", 0, "2020-01-01 10:00:00", "bo"), ("t1", "B", 1, "2020-01-01 11:00:00", "al")]
    with pytest.raises(ValueError):
        read_log(spark, "a.csv")
    register_reader("csv", lambda s, p, **_: s.createDataFrame([], model.EVENT))
    assert read_log(spark, "a.csv").count() == 0


def test_generator(spark):
    g = generate(spark, 50, 10, 10, 90, seed=3)
    n = indices.trace_lengths(g).agg(F.min("n"), F.max("n"), F.count("*")).first()
    assert n[0] >= 10 and n[1] <= 90 and n[2] == 50 and g.select("event_type").distinct().count() == 10
    assert rows(g) == rows(generate(spark, 50, 10, 10, 90, seed=3).repartition(3))


def test_durations(spark):
    data = [("0", "a", 0, dt.datetime(2020, 1, 1, 0, 0), "x"), ("0", "b", 1, dt.datetime(2020, 1, 1, 1, 30), "y"),
            ("1", "b", 0, dt.datetime(2020, 1, 1, 1, 0), "x"), ("1", "a", 1, dt.datetime(2020, 1, 1, 1, 10), "y"), ("1", "c", 2, dt.datetime(2020, 1, 1, 4, 0), "y")]
    log = spark.createDataFrame(data, "trace_id string, event_type string, position int, ts timestamp_ntz, resource string")
    assert kinds(durations.concurrent_pairs(log)) == {("a", "b"): 1, ("b", "a"): 1}
    got = {(r.trace_id, r.position): (str(r.enabled_ts)[11:16], str(r.start_ts)[11:16], r.waiting_time) for r in durations.start_times(log).collect()}
    assert got[("0", 0)] == ("23:00", "23:00", 0)  # the day before
    assert got[("0", 1)] == ("23:00", "01:10", 7800)  # concurrent: as its predecessor; then the resource
    assert got[("1", 2)] == ("01:10", "01:30", 1200)


def test_stream_equals_batch(spark, tmp_path):
    data = sorted(random_log(11, 12), key=lambda x: x[3])
    src, root = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for k in range(3):
        part = data[k * len(data) // 3:(k + 1) * len(data) // 3]
        (src / f"{k}.json").write_text("\n".join(json.dumps({"trace": t, "event_type": e, "timestamp": str(at), "position": i}) for t, e, i, at in part))
        events = spark.readStream.schema(model.STREAM_MESSAGE).json(str(src))
        for q in run_stream(TableStore(spark, root, "s"), events, 2, available_now=True):
            q.awaitTermination()
    store = TableStore(spark, root, "s")
    index = spark.read.parquet(store.path("stream_index")).drop("batch")
    want = pairs.extract_pairs(spark.createDataFrame(data, model.EVENT), 2)
    assert rows(index.select(*want.columns)) == rows(want)
    n = max(int(p.name.split("=")[1]) for p in (tmp_path / "out/s/stream_count").iterdir() if "=" in p.name)
    counts = spark.read.parquet(store.path("stream_count", f"batch={n}"))
    assert rows(counts) == rows(pairs.pair_counts(want))
    m = stream_metadata(store).first()
    assert (m.traces, m.events, m.pairs) == (12, len(data), want.count())


def test_late_events_and_listener(spark, tmp_path):
    src, log = tmp_path / "in", []
    src.mkdir()
    listener = MetricsListener(log.append)
    spark.streams.addListener(listener)
    for k, s in enumerate((5, 3)):
        (src / f"{k}.json").write_text(json.dumps({"trace": "t", "event_type": "a", "timestamp": f"2020-01-01 00:00:0{s}", "position": 0}))
        q = (drop_late(spark.readStream.schema(model.STREAM_MESSAGE).json(str(src))).writeStream.outputMode("append").format("parquet")
             .option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
    spark.streams.removeListener(listener)


def test_cli(spark, tmp_path):
    from tracewright import cli

    cli.main(["--root", str(tmp_path), "--logname", "g", "-t", "20", "-e", "5", "--lmin", "5", "--lmax", "9", "--declare_incremental", "-m", "timestamps", "-c", "zstd"])
    store = TableStore(spark, str(tmp_path), "g")
    assert store.read("index", index_schema("timestamps")).count() == read_metadata(store, Metadata("g")).pairs > 0
    assert store.read("declare_order", model.ORDER_STATE).count() > 0


class Failing(TableStore):
    """Dies at one write, after the folder has been written."""

    left = 10**9

    def _write(self, *args):
        folder = super()._write(*args)
        self.left -= 1
        if self.left < 0:
            raise OSError("lost")
        return folder


TABLES = [("sequence", model.EVENT), ("single", model.EVENT), ("detailed", model.DETAILED), ("index", index_schema("positions")), ("last_checked", model.LAST_CHECKED), ("count", NESTED_COUNT),
          ("declare_position", model.POSITION_STATE), ("declare_existence", model.EXISTENCE_STATE), ("declare_unordered_u", model.UNORDERED_U), ("declare_unordered_i", model.UNORDERED_I),
          ("declare_order", model.ORDER_STATE), ("declare_negatives", model.NEGATIVE), ("declare_mined", model.MINED)]


def test_retries_after_writes(spark, tmp_path, request):
    """Indexing and mining that die after their first, third ... write (first, fourth ...) and are run again give what one clean run gives."""
    logs = [frame(spark, log).withColumn("resource", F.lit("r")).withColumn("start_ts", F.col("ts")).withColumn("waiting_time", F.lit(0).cast("long")) for log in (TEST1, TEST2)]
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", "8"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    clean, store = TableStore(spark, str(tmp_path / "clean"), "log"), Failing(spark, str(tmp_path / "failing"), "log")
    for log in logs:
        index_batch(clean, log, Metadata("log"), detailed=True)
        mine_constraints(clean)
    index_batch(store, logs[0], Metadata("log"), detailed=True)
    mine_constraints(store)
    for job, step in ((lambda: index_batch(store, logs[1], Metadata("log"), detailed=True), 2), (lambda: mine_constraints(store), 3)):
        for n in range(0, 100, step):
            store.left, before = n, store.tables()
            try:
                job()
                break
            except OSError:
                assert store.tables() == before
        assert n >= 8
    for name, schema in TABLES:
        assert rows(store.read(name, schema)) == rows(clean.read(name, schema)) != [], name
    assert read_metadata(store, Metadata("log")) == read_metadata(clean, Metadata("log"))


def test_delete_all(spark, tmp_path):
    for name in ("a", "b"):
        index_batch(TableStore(spark, str(tmp_path / "root"), name), frame(spark, LOG1), Metadata(name))
    (tmp_path / "other").mkdir()
    TableStore(spark, str(tmp_path / "root"), "a").delete_all()
    assert not list((tmp_path / "root").iterdir()) and (tmp_path / "other").exists()


def test_start_times_of_a_busy_resource(spark):
    """Hours without an event, ties, and events without a resource, against a walk over all events."""
    rnd, data = random.Random(3), []
    for t in range(40):
        at = dt.datetime(2021, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 5000))
        for i in range(20):
            at += dt.timedelta(minutes=rnd.choice([0, 1, 30, 300]))
            data.append((str(t), rnd.choice("abc"), i, at, rnd.choice(["busy", "busy", "x", None])))
    log = spark.createDataFrame(data, "trace_id string, event_type string, position int, ts timestamp_ntz, resource string")
    enabled = {(r.trace_id, r.position): r.enabled_ts for r in durations.enablement(log).collect()}
    want = {}
    for t, _, i, at, r in data:
        earlier = [x[3] for x in data if r is not None and x[4] == r and x[3] < at]
        want[t, i] = max([enabled[t, i], *earlier])
    assert {(r.trace_id, r.position): r.start_ts for r in durations.start_times(log).collect()} == want


def test_streaming_cli(spark, tmp_path):
    from tracewright import cli
    from tracewright.sources.readers import replay

    for _ in replay(spark.createDataFrame(random_log(13, 9), model.EVENT), str(tmp_path / "in"), 1):
        cli.main(["--system", "streaming", "--root", str(tmp_path / "out"), "--logname", "s", "--source_format", "text", "--source_option", f"path={tmp_path / 'in'}",
                  "--available_now", "--drop_late", "--metrics", str(tmp_path / "metrics.json")])
    store = TableStore(spark, str(tmp_path / "out"), "s")
    assert rows(read_stream(store, "index", model.PAIR)) == rows(pairs.extract_pairs(spark.createDataFrame(random_log(13, 9), model.EVENT), 30).select(*model.PAIR.names))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    records = [json.loads(x) for x in (tmp_path / "metrics.json").read_text().splitlines()]
    assert {"started", "progress", "terminated"} <= {r["event"] for r in records} and any(r.get("rows") for r in records)


def test_detailed_cli(spark, tmp_path):
    from tracewright import cli

    path = tmp_path / "x.withTimestamp"
    path.write_text("0::a/delab/2020-08-15 12:56:42/delab/r1,b/delab/2020-08-16 12:56:42/delab/r2\n1::c/delab/2020-08-15 01:00:00/delab/r1")
    cli.main(["--root", str(tmp_path / "out"), "--logname", "d", "-f", str(path), "--duration_determination"])
    got = TableStore(spark, str(tmp_path / "out"), "d").read("detailed", model.DETAILED).collect()
    assert {(r.trace_id, r.position): (str(r.start_ts), r.waiting_time) for r in got} == {
        ("0", 0): ("2020-08-15 12:00:00", 0), ("0", 1): ("2020-08-15 12:56:42", 0), ("1", 0): ("2020-08-15 00:00:00", 0)}


def test_state_expires(spark, tmp_path):
    """A trace that is silent for longer than the lookback forgets its open events and keeps its position."""
    src = tmp_path / "in"
    src.mkdir()
    store = TableStore(spark, str(tmp_path / "out"), "s")
    for k, batch in enumerate(([("t", "a", "2020-01-01")], [("u", "x", "2020-02-01")], [("u", "x", "2020-02-02")], [("t", "b", "2020-02-03")])):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"trace": t, "event_type": e, "timestamp": f"{day} 00:00:00", "position": 0}) for t, e, day in batch))
        for q in run_stream(store, spark.readStream.schema(model.STREAM_MESSAGE).json(str(src)), 5, available_now=True):
            q.awaitTermination()
    got = read_stream(store, "index", model.PAIR).collect()
    assert [(r.trace_id, r.eventA, r.eventB) for r in got] == [("u", "x", "x")]


def test_tiny_tables(spark, tmp_path):
    for t in ("events", "conversations", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, q in QUERIES.items():
        if name not in ("synthetic_trace_stats", "pairs_compat_ties"):
            q(spark, str(tmp_path)).collect()
