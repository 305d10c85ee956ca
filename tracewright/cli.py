"""Command line: ``python -m tracewright.cli --file log.withTimestamp --logname test``."""
from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tracewright.model import CODECS, MODES
from tracewright.operators.durations import concurrent_pairs
from tracewright.plans.indexing import Metadata, index_batch, mine_constraints, waiting_columns
from tracewright.sources.generator import generate
from tracewright.sources.readers import read_log
from tracewright.sources.store import TableStore


def _positive(x: str) -> int:
    if int(x) <= 0:
        raise argparse.ArgumentTypeError("a positive number is needed")
    return int(x)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tracewright")
    p.add_argument("--system", choices=("batch", "streaming"), default="batch")
    p.add_argument("--root", default="tracewright-data")
    p.add_argument("-m", "--mode", choices=MODES, default="positions")
    p.add_argument("-c", "--compression", choices=CODECS, default="snappy")
    p.add_argument("-f", "--file", default="synthetic")
    p.add_argument("--logname", default="log")
    p.add_argument("--delete_all", action="store_true")
    p.add_argument("--delete_prev", action="store_true")
    p.add_argument("--lookback", type=_positive, default=30)
    p.add_argument("--declare_incremental", action="store_true")
    p.add_argument("-t", "--traces", type=_positive, default=100)
    p.add_argument("-e", "--event_types", type=_positive, default=10)
    p.add_argument("--lmin", type=_positive, default=10)
    p.add_argument("--lmax", type=_positive, default=90)
    p.add_argument("--seed", type=int, default=7)
    p.add_argument("--duration_determination", action="store_true")
    p.add_argument("--source_format", default="kafka", help="streaming: kafka, or text for a folder of JSON lines")
    p.add_argument("--source_option", action="append", default=[], metavar="KEY=VALUE")
    p.add_argument("--drop_late", action="store_true", help="streaming: drop events that are not later than the last one of their trace")
    p.add_argument("--metrics", metavar="FILE", help="streaming: a file of the driver for starts, progress and ends of the queries, a JSON line each")
    p.add_argument("--available_now", action="store_true", help="streaming: end when what is there has been read")
    return p


def main(args: list[str] | None = None) -> None:
    c = parser().parse_args(args)
    spark = SparkSession.builder.appName("tracewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = TableStore(spark, c.root, c.logname, c.compression)
    if c.delete_all:
        store.delete_all()
    elif c.delete_prev:
        store.delete_log()
    if c.system == "streaming":
        from tracewright.sources.readers import decode_messages, stream_source
        from tracewright.streaming.engine import lines_to, run_stream

        raw = stream_source(spark, c.source_format, **dict(x.split("=", 1) for x in c.source_option))
        for q in run_stream(store, decode_messages(raw), c.lookback, c.available_now, not c.drop_late, lines_to(c.metrics) if c.metrics else None):
            q.awaitTermination()
        return
    if c.file == "synthetic":
        log = generate(spark, c.traces, c.event_types, c.lmin, c.lmax, c.seed)
    else:
        log = read_log(spark, c.file, detailed=c.duration_determination)
    detailed = c.duration_determination and "resource" in log.columns
    if detailed:
        log = waiting_columns(log, concurrent_pairs(log))
    index_batch(store, log, Metadata(c.logname, c.mode, c.compression, c.lookback, filename=c.file), detailed)
    if c.declare_incremental:
        mine_constraints(store)


if __name__ == "__main__":
    main()
