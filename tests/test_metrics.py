import math
import random

import pytest
from pyspark.sql import functions as F

from ringfold.functions.buckets import bucket_index
from ringfold.operators import metrics as M

BOUNDS = [1.0, 2.5, 10.0, 100.0]


def sample_table(spark, rows):
    return spark.createDataFrame(rows, "us bigint, append_ms bigint, end_ms bigint").withColumn(
        "ts", F.timestamp_micros("us")
    )


def test_bucket_index(spark):
    values = [-5.0, 0.0, 1.0, 1.1, 2.5, 9.99, 10.0, 10.01, 100.0, 1e9]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    df = df.select("x", bucket_index(F.col("x"), BOUNDS).alias("b"))
    for r in df.collect():
        assert r.b == sum(b < r.x for b in BOUNDS)


@pytest.mark.parametrize("bad", [[], [1.0, 1.0], [2.0, 1.0]])
def test_bad_bounds(bad):
    with pytest.raises(ValueError):
        bucket_index(F.lit(1), bad)


def test_default_bounds():
    bounds = M.default_bounds()
    assert bounds[0] == 1 and bounds[-1] == 10_000 and bounds == sorted(set(bounds))


def test_negative_latencies_are_apart(spark):
    df = M.latencies(sample_table(spark, [(0, 10, 4), (0, 4, 10), (0, 5, 5)])).select("sign", "latency")
    assert sorted(tuple(r) for r in df.collect()) == [("latency", 0), ("latency", 6), ("negative", 6)]


def interpolated(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = math.floor(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_percentiles(spark):
    rng = random.Random(1)
    rows = [(0, rng.randrange(-50, 300), 0) for _ in range(1000)]
    exact = M.latency_percentiles(M.latencies(sample_table(spark, rows))).collect()
    assert len(exact) == 8
    for r in exact:
        mine = [abs(a) for _, a, _ in rows if (a >= 0) == (r.sign == "latency")]
        assert r.n == len(mine) and math.isclose(r.value, interpolated(mine, r.percentile))
    close = M.latency_percentiles(M.latencies(sample_table(spark, rows)), accuracy=10_000).collect()
    assert {(r.sign, r.percentile): r.n for r in close} == {(r.sign, r.percentile): r.n for r in exact}


def test_histogram_counts_every_bound(spark):
    rows = [(0, x, 0) for x in (0, 1, 2, 3, 50, 1000)]
    found = M.latency_histogram(M.latencies(sample_table(spark, rows)), BOUNDS).collect()
    assert {r.le: r.cumulative for r in found} == {1.0: 2, 2.5: 3, 10.0: 4, 100.0: 5, math.inf: 6}


def quantile(values, q):
    counts = [sum(1 for v in values if sum(b < v for b in BOUNDS) == i) for i in range(len(BOUNDS) + 1)]
    rank, cumulative = q * len(values), 0
    for i, n in enumerate(counts):
        if n and cumulative + n >= rank:
            if i == len(BOUNDS):
                return BOUNDS[-1]
            low = 0 if i == 0 else BOUNDS[i - 1]
            return low + (BOUNDS[i] - low) * (rank - cumulative) / n
        cumulative += n


@pytest.mark.parametrize("step", [5, 20])
def test_windowed_quantiles(spark, step):
    rng = random.Random(2)
    rows = [(rng.randrange(0, 60_000_000), rng.choice([0, 1, 2, 7, 60, 400]), 0) for _ in range(300)]
    samples = M.latencies(sample_table(spark, rows))
    found = M.windowed_histogram_quantile(samples, BOUNDS, (0.05, 0.5, 0.99, 1.0), 20, step)
    seen = set()
    for r in found.collect():
        inside = [x for us, x, _ in rows if r.start_us <= us < r.start_us + 20_000_000]
        assert r.samples == len(inside) and math.isclose(r.value, quantile(inside, r.quantile)), r
        seen.add(r.start_us)
    starts = {us // (step * 10**6) * step * 10**6 - k * step * 10**6 for us, _, _ in rows for k in range(20 // step)}
    assert seen == starts


def test_total_quantiles_skip_the_warm_up(spark):
    rows = [(s * 1_000_000, 400 if s < 180 else 2, 0) for s in range(0, 700, 5)]
    found = M.total_histogram_quantile(M.latencies(sample_table(spark, rows)), BOUNDS, (1.0,)).collect()
    assert [(r.samples, r.value) for r in found] == [(104, 2.5)]


@pytest.mark.parametrize("bad", [0, 7])
def test_bad_step(spark, bad):
    with pytest.raises(ValueError):
        M.windowed_bucket_counts(sample_table(spark, []), BOUNDS, 20, bad)


def test_offset_throughput_ignores_resets(spark):
    rows = [(0, "t", 0, 0), (10, "t", 0, 100), (20, "t", 0, 20), (30, "t", 0, 50), (0, "t", 1, 0), (10, "t", 1, 30)]
    samples = spark.createDataFrame(rows, "s bigint, topic string, partition int, committed_offset bigint").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    got = {r.start_us // 10**6: r.per_second for r in M.offset_throughput(samples, 10).collect()}
    assert got == {10: 13.0, 30: 3.0}


def test_rollup(spark):
    rows = [(rep, s * 10**6, float(v)) for rep, v in (("a", 10), ("b", 20), ("c", 90)) for s in range(0, 300, 60)]
    rows += [(rep, -1, 10_000.0) for rep in "abc"]
    values = spark.createDataFrame(rows, "repetition string, start_us bigint, value double")
    r = M.run_rollup(values, 60).first()
    assert (r.repetitions, r.median) == (3, 20.0)


@pytest.mark.parametrize("growth, fine", [(0.5, True), (2.0, False), (-1.0, True)])
def test_lag_trend(spark, growth, fine):
    rows = [(s, 1000 * s, int(1000 * s - 500 - growth * s) if s >= 120 else 0) for s in range(0, 600, 10)]
    samples = spark.createDataFrame(rows, "s bigint, end_offset bigint, committed_offset bigint").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    r = M.lag_trend(samples, 100.0).first()
    assert math.isclose(r.slope, growth, abs_tol=1e-6) and r.sustainable is fine and r.n_samples == 48


def test_lag_trend_warms_up_per_key(spark):
    # the late key's first minute would not be left out by the warm-up of the early one
    rows = [("early", s, 10 * s, 0) for s in range(0, 300, 10)]
    rows += [(None, s, (5000 if s < 1060 else 2 * s), 0) for s in range(1000, 1300, 10)]
    samples = spark.createDataFrame(rows, "key string, s bigint, end_offset bigint, committed_offset bigint")
    samples = samples.withColumn("ts", F.timestamp_seconds("s"))
    found = M.lag_trend(samples, 1000.0, ["key"], warmup_s=60).collect()
    got = {r.key: (r.n_samples, round(r.slope, 6), r.sustainable) for r in found}
    assert got == {"early": (24, 10.0, True), None: (24, 2.0, True)}
