"""Rates of counters over a sliding look-back, counters that start over included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringfold.operators.metrics import MICROS


def _growth(value: Column, before: Column) -> Column:
    """What a counter has counted since ``before``; one that fell has started over from 0."""
    return F.when(value < before, value).otherwise(value - before)


def sliding_rate(
    samples: DataFrame, keys: Sequence[str], length_s: int, step_s: int, ts: str = "ts", value: str = "committed_offset"
) -> DataFrame:
    """``(keys, end_us, n_samples, increase, per_second)`` at every multiple of ``step_s``.

    The look-back of an end is ``(end - length_s, end]``. ``increase`` is the growth between
    its first and last sample; where the counter falls it has started over, and counts from
    0. ``per_second`` divides by the time between these two, so it needs two of them. An end
    has a row as long as two samples are in its look-back, also when none is in its last
    step. Of samples of a key at one time the largest counts; samples without a time or a
    value are left out.

    Samples are reduced per step, in a window by key and step, so a key with most of all
    samples is worked on by as many tasks as it has steps. Only steps meet per key.
    """
    if step_s < 1 or length_s < step_s or length_s % step_s:
        raise ValueError("the look-back must be a multiple of the step")
    step = step_s * MICROS
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    end = us + F.pmod(-us, F.lit(step))
    known = samples.select(*keys, us.alias("us"), end.alias("end_us"), F.col(value).alias("value"))
    known = known.where(F.col("us").isNotNull() & F.col("value").isNotNull())
    single = known.groupBy(*keys, "end_us", "us").agg(F.max("value").alias("value"))
    inside = W.partitionBy(*keys, "end_us").orderBy("us")
    grown = single.withColumn("grown", _growth(F.col("value"), F.lag("value").over(inside)))
    steps = grown.groupBy(*keys, "end_us").agg(
        F.count("*").alias("n"),
        F.sum("grown").alias("inside"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.min_by("value", "us").alias("first"),
        F.max_by("value", "us").alias("last"),
    )
    per_key = W.partitionBy(*keys).orderBy("end_us")
    between = _growth(F.col("first"), F.lag("last").over(per_key))
    latest = F.col("end_us") + (length_s * MICROS - step)
    following = F.lead("end_us").over(per_key) - step
    steps = steps.withColumn("between", between).withColumn("until", F.least(latest, F.coalesce(following, latest)))
    # steps without a sample that still look back on one
    ends = F.posexplode(F.sequence("end_us", "until", F.lit(step))).alias("gap", "at_us")
    own = F.col("gap") == 0
    dense = steps.select("*", ends).select(
        *keys,
        F.col("at_us").alias("end_us"),
        *[F.when(own, F.col(c)).alias(c) for c in ("n", "inside", "between", "first_us", "last_us")],
    )
    back = per_key.rangeBetween(-(length_s * MICROS - step), 0)
    # the growth up to the first sample of the look-back is not part of it
    before = F.min(F.when(F.col("n").isNotNull(), F.struct("end_us", "between"))).over(back)["between"]
    totals = dense.select(
        *keys,
        "end_us",
        F.sum("n").over(back).alias("n_samples"),
        (
            F.coalesce(F.sum("inside").over(back), F.lit(0))
            + F.coalesce(F.sum("between").over(back), F.lit(0))
            - F.coalesce(before, F.lit(0))
        ).alias("increase"),
        ((F.max("last_us").over(back) - F.min("first_us").over(back)) / F.lit(float(MICROS))).alias("seconds"),
    )
    return totals.where("n_samples > 1").select(
        *keys, "end_us", "n_samples", "increase", (F.col("increase") / F.col("seconds")).alias("per_second")
    )


def total_rate(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates of several counters added up per ``keys`` and end."""
    return rates.groupBy(*keys, "end_us").agg(F.count("*").alias("counters"), F.sum("per_second").alias("per_second"))
