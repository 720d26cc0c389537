"""Measurements of a run: latency, throughput, roll-ups and the lag trend.

Samples are counted per distinct value or bucket before anything is shuffled or spread
over windows, so later steps see tables whose size depends on the number of windows and
buckets and not on the number of samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringfold.functions.buckets import bucket_index, check_bounds
from ringfold.functions.payload import event_unpack
from ringfold.functions.timing import latency_ms, latency_sign

PERCENTILES = (0.5, 0.95, 0.99, 0.999)
# Quantiles that a run reports: 5% steps, then 99% and the maximum.
QUANTILES = tuple(k / 20 for k in range(1, 20)) + (0.99, 1.0)
MICROS = 1_000_000


def default_bounds(low: float = 1, high: float = 10_000, per_doubling: int = 3) -> list[float]:
    """Bucket bounds in milliseconds from ``low`` to ``high``, evenly spaced per doubling."""
    bounds, start = [], float(low)
    while start < high:
        bounds += [start * (1 + k / per_doubling) for k in range(per_doubling)]
        start *= 2
    return sorted({round(b, 3) for b in bounds if b < high} | {float(high)})


def event_deliveries(events: DataFrame) -> DataFrame:
    """``(key, append_ms, end_ms)`` of packed events ``(key, value, append_ms)``."""
    return events.select("key", "append_ms", event_unpack(F.col("value"))["end_ms"].alias("end_ms"))


def latencies(deliveries: DataFrame) -> DataFrame:
    """Add ``sign`` and the absolute ``latency`` in ms to ``(append_ms, end_ms)`` rows."""
    latency = latency_ms(F.col("append_ms"), F.col("end_ms"))
    return deliveries.select("*", latency_sign(latency).alias("sign"), F.abs(latency).alias("latency"))


def latency_percentiles(
    samples: DataFrame, percentiles: Sequence[float] = PERCENTILES, accuracy: int | None = None
) -> DataFrame:
    """Percentiles of ``(sign, latency)`` per sign, a row each.

    Exact by default, from a count per distinct latency. ``accuracy`` switches to a
    sketch of fixed size, for latencies with very many distinct values.
    """
    ps = F.array(*[F.lit(float(p)) for p in percentiles])
    if accuracy is None:
        counted = samples.groupBy("sign", "latency").agg(F.count("*").alias("n"))
        exact = F.percentile("latency", ps, F.col("n"))
        found = counted.groupBy("sign").agg(F.sum("n").alias("n"), exact.alias("values"))
    else:
        found = samples.groupBy("sign").agg(
            F.count("*").alias("n"), F.percentile_approx("latency", ps, accuracy).cast("array<double>").alias("values")
        )
    return found.select("sign", "n", F.explode(F.arrays_zip(ps.alias("p"), "values")).alias("e")).select(
        "sign", "n", F.col("e.p").alias("percentile"), F.col("e.values").alias("value")
    )


def _bound(bucket: Column, bounds: Sequence[float]) -> Column:
    return F.get(F.array(*[F.lit(b) for b in bounds]), bucket)


def _fill_buckets(counts: DataFrame, keys: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """A row for every bucket of every key, with its own and the cumulative count."""
    per_key = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("found"))
    every = F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))).alias("bucket")
    filled = per_key.select(*keys, "found", every).select(
        *keys, "bucket", F.coalesce(F.element_at("found", F.col("bucket")), F.lit(0)).alias("n")
    )
    up_to = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return filled.withColumn("cumulative", F.sum("n").over(up_to))


def latency_histogram(samples: DataFrame, bounds: Sequence[float] | None = None) -> DataFrame:
    """Cumulative counts per sign and bucket; ``le`` is the bucket's bound, the last +Inf."""
    bounds = default_bounds() if bounds is None else check_bounds(bounds)
    bucket = bucket_index(F.col("latency"), bounds).alias("bucket")
    counts = samples.groupBy("sign", bucket).agg(F.count("*").alias("n"))
    le = F.coalesce(_bound(F.col("bucket"), bounds), F.lit(float("inf")))
    return _fill_buckets(counts, ["sign"], bounds).select("sign", le.alias("le"), F.col("cumulative"))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def windowed_bucket_counts(
    samples: DataFrame, bounds: Sequence[float], length_s: int, step_s: int, ts: str = "ts", value: str = "latency"
) -> DataFrame:
    """Samples per look-back window ``[start, start + length)`` and bucket.

    Counted per step first; only those counts are repeated for the windows that overlap.
    """
    if step_s < 1 or length_s % step_s:
        raise ValueError("the look-back must be a multiple of the step")
    step = step_s * MICROS
    stepped = samples.select(
        (_micros(F.col(ts)) - F.pmod(_micros(F.col(ts)), F.lit(step))).alias("step_us"),
        bucket_index(F.col(value), bounds).alias("bucket"),
    )
    counts = stepped.groupBy("step_us", "bucket").agg(F.count("*").alias("n"))
    if length_s == step_s:
        return counts.withColumnRenamed("step_us", "start_us")
    back = F.explode(F.sequence(F.lit(0), F.lit(length_s // step_s - 1)))
    spread = counts.select("bucket", "n", "step_us", back.alias("back"))
    start = (F.col("step_us") - F.col("back") * step).alias("start_us")
    return spread.groupBy(start, "bucket").agg(F.sum("n").alias("n"))


def histogram_quantiles(
    counts: DataFrame, keys: Sequence[str], bounds: Sequence[float], quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """Quantiles estimated from bucket counts, linear inside a bucket.

    The lowest bucket starts at 0. A quantile beyond the last finite bound is that bound.
    """
    bounds = check_bounds(bounds)
    if not all(0 < q <= 1 for q in quantiles):
        raise ValueError("quantiles must be above 0 and at most 1")
    w = W.partitionBy(*keys)
    up_to = w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    stacked = counts.where(F.col("n") > 0).select(
        *keys, "bucket", "n", F.sum("n").over(up_to).alias("cumulative"), F.sum("n").over(w).alias("samples")
    )
    qs = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile")
    rank = F.col("quantile") * F.col("samples")
    before = F.col("cumulative") - F.col("n")
    bucket = F.col("bucket")
    low = F.when(bucket == 0, F.lit(min(0.0, bounds[0]))).otherwise(_bound(bucket - 1, bounds))
    value = F.when(bucket >= len(bounds), F.lit(bounds[-1])).otherwise(
        low + (_bound(bucket, bounds) - low) * ((rank - before) / F.col("n"))
    )
    return (
        stacked.select("*", qs)
        .where((F.col("cumulative") >= rank) & (before < rank))
        .select(*keys, "samples", "quantile", value.alias("value"))
    )


def windowed_histogram_quantile(
    samples: DataFrame,
    bounds: Sequence[float] | None = None,
    quantiles: Sequence[float] = QUANTILES,
    length_s: int = 20,
    step_s: int | None = None,
) -> DataFrame:
    """Quantiles of non-negative latencies in every look-back window."""
    bounds = default_bounds() if bounds is None else check_bounds(bounds)
    samples = samples.where(F.col("sign") == "latency")
    counts = windowed_bucket_counts(samples, bounds, length_s, step_s or length_s)
    return histogram_quantiles(counts, ["start_us"], bounds, quantiles)


def total_histogram_quantile(
    samples: DataFrame,
    bounds: Sequence[float] | None = None,
    quantiles: Sequence[float] = QUANTILES,
    length_s: int = 720,
    warmup_s: int = 180,
) -> DataFrame:
    """Quantiles over long windows, samples of the warm-up left out."""
    start = samples.agg(F.min(_micros(F.col("ts")))).scalar()
    warm = samples.where(_micros(F.col("ts")) >= start + F.lit(warmup_s * MICROS))
    return windowed_histogram_quantile(warm, bounds, quantiles, length_s)


def _window_start(ts: str, length_s: int) -> Column:
    us = _micros(F.col(ts))
    return us - F.pmod(us, F.lit(length_s * MICROS))


def throughput(records: DataFrame, keys: Sequence[str] = (), length_s: int = 10) -> DataFrame:
    """Records per second in each window."""
    return records.groupBy(*keys, _window_start("ts", length_s).alias("start_us")).agg(
        (F.count("*") / F.lit(float(length_s))).alias("per_second")
    )


def offset_throughput(samples: DataFrame, length_s: int = 10) -> DataFrame:
    """Records per second by topic, from samples ``(ts, topic, partition, committed_offset)``.

    Each partition's samples are reduced to the last one per window. The rate is the
    difference to the window before over the time between the two samples; negative
    rates, left by an offset that was set back, do not count.
    """
    us = _micros(F.col("ts"))
    last = samples.groupBy("topic", "partition", _window_start("ts", length_s).alias("start_us")).agg(
        F.max(us).alias("us"), F.max_by("committed_offset", us).alias("offset")
    )
    w = W.partitionBy("topic", "partition").orderBy("start_us")
    seconds = (F.col("us") - F.lag("us").over(w)) / F.lit(float(MICROS))
    rate = (F.col("offset") - F.lag("offset").over(w)) / seconds
    return (
        last.select("topic", "start_us", rate.alias("rate"))
        .where(F.col("rate") >= 0)
        .groupBy("topic", "start_us")
        .agg(F.sum("rate").alias("per_second"))
    )


def run_rollup(values: DataFrame, warmup_s: int = 120) -> DataFrame:
    """Mean per repetition after its warm-up, then the median over repetitions.

    ``values`` has ``(repetition, start_us, value)``.
    """
    begins = values.groupBy("repetition").agg(F.min("start_us").alias("begin_us"))
    warm = values.join(begins, "repetition").where(F.col("start_us") >= F.col("begin_us") + F.lit(warmup_s * MICROS))
    means = warm.groupBy("repetition").agg(F.avg("value").alias("mean"))
    return means.agg(F.count("*").alias("repetitions"), F.median("mean").alias("median"))


def lag_trend(
    samples: DataFrame, load_per_second: float | Column, keys: Sequence[str] = (), warmup_s: int = 120,
    threshold: float = 0.01,
) -> DataFrame:
    """Slope of the consumer's lag over time, judged against a share of the load.

    ``samples`` has ``(ts, end_offset, committed_offset)``. A run keeps up when its lag
    grows by at most ``threshold`` times the offered records per second. The warm-up of a key
    is counted from its own first sample.
    """
    load = F.lit(float(load_per_second)) if not isinstance(load_per_second, Column) else load_per_second
    us = _micros(F.col("ts"))
    if keys:
        # null keys are a run of their own
        begins = samples.groupBy(*[F.col(k).alias(f"begin_{k}") for k in keys]).agg(F.min(us).alias("begin_us"))
        same = [F.col(k).eqNullSafe(F.col(f"begin_{k}")) for k in keys]
        samples, start = samples.join(begins, same), F.col("begin_us")
    else:
        start = samples.agg(F.min(us)).scalar()
    seconds = (us - start) / F.lit(float(MICROS))
    lag = (F.col("end_offset") - F.col("committed_offset")).cast("double")
    warm = samples.select(*keys, seconds.alias("seconds"), lag.alias("lag")).where(F.col("seconds") >= warmup_s)
    grouped = warm.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.regr_slope("lag", "seconds").alias("slope"))
    return grouped.withColumn("sustainable", F.col("slope") <= load * F.lit(float(threshold)))
