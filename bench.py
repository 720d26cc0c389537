"""Time the headline queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).
Each query runs once to warm up and then ``REPEATS`` times; the best time counts. Results
go to Spark's noop sink, so that every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ringfold.operators.digest import count_window_digest
from ringfold.operators.fanout import match_records, prepare_records, ring_range_join
from ringfold.operators.rules import zipf_rules
from ringfold.plans import catalog
from ringfold.plans import views as v

REPEATS = 2
SIZES = {"1e3": 1_000, "1e5": 100_000, "1e6": 1_000_000}
REGISTERED = [
    "fanout_digest",
    "ring_range_join",
    "match_records",
    "matches_per_rule",
    "count_window_digest",
    "count_window_digest_phased",
    "payload_overlay",
    "running_count_events",
    "wrapping_sum",
    "rule_hit_rate",
    "stream_match",
    "stream_digest",
    "stateful_digest",
    "latency_percentiles",
    "latency_histogram",
    "windowed_histogram_quantile",
    "total_histogram_quantile",
    "throughput",
    "lag_trend",
]


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of 16 bytes per line item, the largest table."""
    line = v.table(spark, sf_dir, "lineitem")
    keys = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return line.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.unhex(F.md5(keys.cast("binary"))).alias("data"),
    )


def fanout(n: int, s: float) -> Callable[[SparkSession, str], DataFrame]:
    """The deployed load: total selectivity 0.2, digests of every 10 matches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ring_range_join(prepare_records(line_records(spark, sf_dir)), zipf_rules(spark, n, 0.2, s))

    return run


def large_fanout(n: int, s: float, broadcast_bytes: int) -> Callable[[SparkSession, str], DataFrame]:
    """An index below the broadcast size, or beyond it: coarse levels are broadcast, the deepest are shuffled."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = zipf_rules(spark, n, 0.2, s)
        return ring_range_join(prepare_records(line_records(spark, sf_dir)), rules, broadcast_bytes=broadcast_bytes)

    return run


def digest(n: int, s: float) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared = prepare_records(line_records(spark, sf_dir), random_phase=True)
        return count_window_digest(match_records(prepared, zipf_rules(spark, n, 0.2, s)), 10)

    return run


def plans() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    chosen = {name: catalog.queries()[name] for name in REGISTERED}
    for label, n in SIZES.items():
        for s in (0.0, 1.0):
            chosen[f"fanout_{label}_rules_s{s:g}"] = fanout(n, s)
    chosen["fanout_3e6_rules_s1_broadcast"] = large_fanout(3_000_000, 1.0, 1 << 30)
    chosen["fanout_3e6_rules_s1_shuffled"] = large_fanout(3_000_000, 1.0, 64 << 20)
    chosen["digest_1e3_rules_s1"] = digest(1_000, 1.0)
    chosen["digest_1e6_rules_s0"] = digest(1_000_000, 0.0)
    return chosen


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ringfold-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    times = {}
    for name, query in plans().items():
        if wanted and name not in wanted:
            continue
        best = float("inf")
        for _ in range(1 + REPEATS):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
        print(f"{name} {best:.3f}", file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
