"""Times the headline queries; prints one JSON line."""
import json
import os
import time

from pyspark.sql import SparkSession

from tracewright.plans.queries import QUERIES

HEADLINE = ("pairs_positions", "count_table", "single_index", "last_checked", "incremental_counts_merged", "declare_order_state", "declare_exactly_n",
            "declare_i", "declare_incremental_delta", "directly_follows", "enablement_time", "start_time_resource", "lineitem_pairs")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda n: QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
