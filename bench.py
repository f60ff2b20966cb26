"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query runs once to warm up
and then BENCH_RUNS times (default 3); the median counts. A run builds the query, which for some
includes jobs of its own, and evaluates every row of the result without collecting it.
"""

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabpact import with_sequence  # noqa: E402
from tabpact.plans.queries import queries  # noqa: E402
from tabpact.staging import remove_staged  # noqa: E402

HEADLINE = (
    "contract_scan",
    "filter_date_range",
    "reject_split_good",
    "check_list",
    "check_first",
    "check_summary_rows",
    "enforce_good",
    "record_mapping",
    "money_parts",
    "row_sequence",
    "row_sequence_1_partitions",
    "row_sequence_8_partitions",
    "row_sequence_64_partitions",
    "row_sequence_ties",
    "format_by_type",
    "render_lines",
    "delimited_roundtrip",
    "adapter_feed",
    "adapter_lines",
    "fan_out",
    "trace_both",
    "cycle_edges",
    "cycle_goods",
    "stream_numbered",
)


def _sequence_over(partitions: int):
    """The row sequence with its input cut into a number of partitions."""

    def run(spark, sf_dir):
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
        return with_sequence(orders.repartition(partitions), ["o_orderdate", "o_orderkey"], rows_per_range=5_000)

    return run


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabpact-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='tabpact-shared-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    registered.update({f"row_sequence_{n}_partitions": _sequence_over(n) for n in (1, 8, 64)})
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            begun = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begun)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], [round(t, 2) for t in times], file=sys.stderr, flush=True)
    remove_staged(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
