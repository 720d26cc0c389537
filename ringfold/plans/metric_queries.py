"""Registered queries: measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.operators import metrics, rates, sketches
from ringfold.operators.digest import pack_digests
from ringfold.plans import sql
from ringfold.plans import views as v
from ringfold.plans.shared import EVENT_MATCHES, EVERY, digests, register
from ringfold.workdir import stored

BOUNDS = metrics.default_bounds()
DAY_S = 24 * 3600
WARMUP_S = 6 * 3600
LOOK_BACK_S, STEP_S = 3 * 3600, 3600
STEP_US = STEP_S * metrics.MICROS


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latencies(v.deliveries(spark, sf_dir))


@register(
    "latency_percentiles",
    sql.query(
        sql.DELIVERIES,
        f"""
found AS (
  SELECT sign, count(*) AS n, unnest({list(metrics.PERCENTILES)}::DOUBLE[]) AS percentile,
         unnest(quantile_cont(latency, {list(metrics.PERCENTILES)}::DOUBLE[])) AS value
  FROM samples GROUP BY sign
)""",
        select="SELECT sign, n, percentile, round(value, 6) AS value FROM found",
    ),
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.latency_percentiles(_samples(spark, sf_dir))
    return found.withColumn("value", F.round("value", 6))


@register(
    "event_latency",
    sql.query(
        *EVENT_MATCHES,
        sql.numbered(EVERY),
        sql.digest(EVERY),
        "delays AS (SELECT rule_id AS key, cycle * 7919 % 12000 - 500 AS delay FROM digests)",
        select="""
SELECT key, CASE WHEN delay >= 0 THEN 'latency' ELSE 'negative' END AS sign, count(*) AS n, max(abs(delay)) AS latency
FROM delays GROUP BY 1, 2""",
    ),
)
def event_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digests(v.rec_events(spark, sf_dir), v.subscriptions(spark, sf_dir))
    arrival = F.col("end_ms") + F.col("cycle") * 7919 % 12000 - 500
    events = pack_digests(found.withColumn("append_ms", arrival), carry=["append_ms"])
    samples = metrics.latencies(metrics.event_deliveries(events))
    return samples.groupBy("key", "sign").agg(F.count("*").alias("n"), F.max("latency").alias("latency"))


@register(
    "latency_histogram",
    sql.query(
        sql.DELIVERIES,
        sql.bounds_table(BOUNDS + ["'Infinity'"]),
        "signs AS (SELECT DISTINCT sign FROM samples)",
        select="""
SELECT s.sign, b.le, (SELECT count(*) FROM samples x WHERE x.sign = s.sign AND x.latency <= b.le) AS cumulative
FROM signs s, bounds b""",
    ),
)
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_histogram(_samples(spark, sf_dir), BOUNDS)


def _quantile_sql(windows: str, quantiles: tuple[float, ...] = metrics.QUANTILES) -> str:
    """Histogram quantiles over rows ``(start_us, latency)`` named by ``windows``."""
    qs = list(quantiles)
    top = BOUNDS[-1]
    return sql.query(
        sql.DELIVERIES,
        windows,
        sql.bounds_table(BOUNDS),
        f"""
bucketed AS (
  SELECT start_us, coalesce((SELECT min(bucket) FROM bounds WHERE le >= latency), {len(BOUNDS)}) AS bucket, count(*) AS n
  FROM windowed GROUP BY 1, 2
),
stacked AS (
  SELECT *, sum(n) OVER (PARTITION BY start_us ORDER BY bucket) AS cumulative, sum(n) OVER (PARTITION BY start_us) AS samples
  FROM bucketed
),
quantiles AS (SELECT unnest({qs}::DOUBLE[]) AS quantile),
ranked AS (
  SELECT *, quantile * samples AS rank,
         row_number() OVER (PARTITION BY start_us, quantile ORDER BY bucket) AS place
  FROM stacked, quantiles WHERE cumulative >= quantile * samples
)""",
        select=f"""
SELECT start_us, samples::BIGINT AS samples, quantile,
       round(CASE WHEN r.bucket = {len(BOUNDS)} THEN {top}
             ELSE coalesce(low.le, 0) + (high.le - coalesce(low.le, 0)) * ((rank - (cumulative - n)) / n) END, 6) AS value
FROM ranked r LEFT JOIN bounds high ON high.bucket = r.bucket LEFT JOIN bounds low ON low.bucket = r.bucket - 1
WHERE place = 1""",
    )


@register(
    "windowed_histogram_quantile",
    _quantile_sql(
        """
windowed AS (
  SELECT (epoch_us(ts) // 5000000 - back) * 5000000 AS start_us, latency
  FROM samples, (SELECT unnest(range(4)) AS back) WHERE sign = 'latency'
)"""
    ),
)
def windowed_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.windowed_histogram_quantile(_samples(spark, sf_dir), BOUNDS, metrics.QUANTILES, 20, 5)
    return found.withColumn("value", F.round("value", 6))


@register(
    "total_histogram_quantile",
    _quantile_sql(
        """
windowed AS (
  SELECT epoch_us(ts) // 720000000 * 720000000 AS start_us, latency FROM samples
  WHERE sign = 'latency'
    AND epoch_us(ts) >= (SELECT min(epoch_us(ts)) FROM samples WHERE sign = 'latency') + 180000000
)"""
    ),
)
def total_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir).where(F.col("sign") == "latency")
    return metrics.total_histogram_quantile(samples, BOUNDS).withColumn("value", F.round("value", 6))


@register(
    "throughput",
    """
SELECT event_type, epoch_us(ts) // 10000000 * 10000000 AS start_us, count(*) / 10.0::DOUBLE AS per_second
FROM events GROUP BY 1, 2""",
)
def record_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return metrics.throughput(events, ["event_type"])


@register(
    "offset_throughput",
    f"""
WITH samples AS (
  SELECT epoch_us(ts) AS us, 'topic' || (user_id % 2) AS topic, length(event_type) AS partition,
         event_id * 10 - CASE WHEN event_id % 97 = 0 THEN 5000 ELSE 0 END AS "offset"
  FROM events
),
last AS (
  SELECT topic, partition, us // 3600000000 * 3600000000 AS start_us, max(us) AS us, max_by("offset", us) AS "offset"
  FROM samples GROUP BY 1, 2, 3
),
rates AS (
  SELECT topic, start_us, ("offset" - lag("offset") OVER w) / ((us - lag(us) OVER w) / 1000000::DOUBLE) AS rate
  FROM last WINDOW w AS (PARTITION BY topic, partition ORDER BY start_us)
)
SELECT topic, start_us, round(sum(rate), 6) AS per_second FROM rates WHERE rate >= 0 GROUP BY 1, 2""",
)
def offset_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.offset_throughput(v.partition_samples(spark, sf_dir), 3600)
    return found.withColumn("per_second", F.round("per_second", 6))


@register(
    "offset_rate_sliding",
    f"""
WITH samples AS (
  SELECT 'topic' || (user_id % 2) AS topic, length(event_type) AS partition, epoch_us(ts) AS us,
         max(event_id * 10 - CASE WHEN event_id % 97 = 0 THEN 5000 ELSE 0 END) AS value
  FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3
),
before AS (SELECT *, lag(value) OVER (PARTITION BY topic, partition ORDER BY us) AS prior FROM samples),
grown AS (SELECT *, CASE WHEN value < prior THEN value ELSE value - prior END AS grown FROM before),
met AS (
  SELECT topic, partition, (ceil(us / {STEP_US}.0)::BIGINT + back) * {STEP_US} AS end_us, us, grown
  FROM grown, (SELECT unnest(range({LOOK_BACK_S // STEP_S})) AS back)
),
rates AS (
  SELECT topic, partition, end_us,
         (coalesce(sum(grown), 0) - coalesce((min_by(struct_pack(g := grown), us)).g, 0)) / ((max(us) - min(us)) / 1000000::DOUBLE) AS rate
  FROM met GROUP BY 1, 2, 3 HAVING count(*) > 1
)
SELECT topic, end_us, count(*) AS counters, round(sum(rate), 6) AS per_second FROM rates GROUP BY 1, 2""",
)
def offset_rate_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = v.partition_samples(spark, sf_dir)
    found = rates.total_rate(rates.sliding_rate(samples, ["topic", "partition"], LOOK_BACK_S, STEP_S), ["topic"])
    return found.withColumn("per_second", F.round("per_second", 6))


#: The quantiles that are checked, and the windows: hours are sketched, days and the whole run are merged.
SKETCH_KEYS = ["level", "sign"]
HOUR_US, DAY_US = 3600 * metrics.MICROS, DAY_S * metrics.MICROS
SKETCH_ERROR = 3 * sketches.rank_error()


@register(
    "sketched_quantiles",
    sql.query(
        sql.DELIVERIES,
        f"""
windows AS (
  SELECT 'hour' AS level, sign, epoch_us(ts) // {HOUR_US} * {HOUR_US} AS start_us, latency FROM samples
  UNION ALL SELECT 'day', sign, epoch_us(ts) // {DAY_US} * {DAY_US}, latency FROM samples
  UNION ALL SELECT 'run', sign, 0, latency FROM samples
)""",
        select=f"""
SELECT level, sign, start_us, count(*) AS samples, unnest({list(metrics.QUANTILES)}::DOUBLE[]) AS quantile, true AS within
FROM windows WHERE latency IS NOT NULL GROUP BY level, sign, start_us""",
    ),
)
def sketched_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each quantile's exact rank is within the stated error of a sketch."""
    samples = _samples(spark, sf_dir).where(F.col("latency").isNotNull())
    hours = stored(sketches.step_sketches(samples, ["sign"], 3600), "hour-sketches")
    days = stored(sketches.window_sketches(hours, ["sign"], DAY_S, 3600), "day-sketches")
    levels = {"hour": hours, "day": days, "run": sketches.run_sketches(days, ["sign"])}
    us = F.unix_micros("ts")
    starts = {"hour": us - F.pmod(us, F.lit(HOUR_US)), "day": us - F.pmod(us, F.lit(DAY_US)), "run": F.lit(0).cast("bigint")}
    checked = None
    for level, found in levels.items():
        quantiles = sketches.sketch_quantiles(found, ["sign"])
        counts = samples.groupBy("sign", starts[level].alias("start_us"), F.col("latency").alias("value")).agg(F.count("*").alias("n"))
        rows = sketches.ranks(quantiles, counts, ["sign"]).withColumn("level", F.lit(level))
        checked = rows if checked is None else checked.unionByName(rows)
    q = F.col("quantile")
    within = (F.col("below") <= q + SKETCH_ERROR) & (F.col("up_to") >= q - SKETCH_ERROR)
    return checked.select(*SKETCH_KEYS, "start_us", "samples", "quantile", within.alias("within"))


@register(
    "run_rollup",
    f"""
WITH rates AS (
  SELECT event_type AS repetition, epoch_us(ts) // 3600000000 * 3600000000 AS start_us, count(*) / 3600::DOUBLE AS value
  FROM events GROUP BY 1, 2
),
means AS (
  SELECT repetition, avg(value) AS mean
  FROM rates JOIN (SELECT repetition, min(start_us) AS begin_us FROM rates GROUP BY 1) USING (repetition)
  WHERE start_us >= begin_us + {WARMUP_S} * 1000000::BIGINT GROUP BY 1
)
SELECT count(*) AS repetitions, round(median(mean), 9) AS median FROM means""",
)
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("repetition"), F.col("ts").cast("timestamp").alias("ts")
    )
    hourly = metrics.throughput(events, ["repetition"], 3600).withColumnRenamed("per_second", "value")
    return metrics.run_rollup(hourly, WARMUP_S).withColumn("median", F.round("median", 9))


@register(
    "lag_trend",
    sql.query(
        sql.LAG_SAMPLES,
        f"""
timed AS (
  SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM lag_samples)) / 1000000::DOUBLE AS seconds,
         (end_offset - committed_offset)::DOUBLE AS lag
  FROM lag_samples
),
fitted AS (SELECT count(*) AS n_samples, regr_slope(lag, seconds) AS slope FROM timed WHERE seconds >= {WARMUP_S})""",
        select="""
SELECT n_samples, round(slope, 9) AS slope, slope <= 0.01 * (SELECT count(*) / 2592000::DOUBLE FROM events) AS sustainable
FROM fitted""",
    ),
)
def lag_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = v.table(spark, sf_dir, "events").count() / (30 * DAY_S)
    trend = metrics.lag_trend(v.lag_samples(spark, sf_dir), load, warmup_s=WARMUP_S)
    return trend.withColumn("slope", F.round("slope", 9))
