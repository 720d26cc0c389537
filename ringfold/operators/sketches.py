"""Quantiles from stored sketches, merged instead of reading samples again.

Samples are reduced once to a sketch of bounded size per key and time step. Longer windows,
and the whole run, are merges of those sketches: their cost depends on the number of steps
and not on the number of samples, and the steps may be stored and added to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfold.operators.metrics import MICROS, QUANTILES

#: Size parameter of a sketch, from 8 to 65,535: some 3 * K values are kept.
K = 800
#: Start of the window that holds the whole run.
RUN_START_US = 0


def rank_error(k: int = K) -> float:
    """Rank error of a sketch, as a share of its samples, that 99 of 100 estimates keep to.

    Merging leaves it as it is; up to some ``k`` samples a sketch is exact.
    """
    return 2.296 / k**0.9021


def step_sketches(
    samples: DataFrame, keys: Sequence[str] = (), step_s: int = 20, k: int = K, ts: str = "ts", value: str = "latency"
) -> DataFrame:
    """``(keys, start_us, samples, sketch)`` per time step, of whole numbers in ``value``.

    Sketches are built before the shuffle and merged after it. Null values are left out, a
    step with nothing else has no row. Samples without a time are a step with a null start,
    which is in no longer window but in the whole run.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    start = us - F.pmod(us, F.lit(step_s * MICROS))
    number = F.col(value).cast("bigint")
    known = samples.where(number.isNotNull())
    return known.groupBy(*keys, start.alias("start_us")).agg(
        F.count("*").alias("samples"), F.kll_sketch_agg_bigint(number, k).alias("sketch")
    )


def _merged(sketches: DataFrame, keys: Sequence[str], start: Column, k: int) -> DataFrame:
    return sketches.groupBy(*keys, start.alias("start_us")).agg(
        F.sum("samples").alias("samples"), F.kll_merge_agg_bigint("sketch", k).alias("sketch")
    )


def window_sketches(
    sketches: DataFrame, keys: Sequence[str] = (), length_s: int = 720, step_s: int = 20, every_s: int | None = None,
    k: int = K,
) -> DataFrame:
    """Sketches of windows of ``length_s`` from those of steps of ``step_s``.

    Windows follow each other, or start every ``every_s`` seconds and overlap; then the
    sketches, not the samples, are repeated.
    """
    every_s = every_s or length_s
    if step_s < 1 or every_s % step_s or length_s % every_s:
        raise ValueError("the window must be a multiple of its hop, and that of the step")
    known = sketches.where(F.col("start_us").isNotNull())
    last = F.col("start_us") - F.pmod("start_us", F.lit(every_s * MICROS))
    if every_s == length_s:
        return _merged(known, keys, last, k)
    back = F.explode(F.sequence(F.lit(0), F.lit(length_s // every_s - 1))).alias("back")
    spread = known.select(*keys, "samples", "sketch", last.alias("last_us"), back)
    return _merged(spread, keys, F.col("last_us") - F.col("back") * (every_s * MICROS), k)


def run_sketches(sketches: DataFrame, keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """One sketch per key over all steps, under the start ``RUN_START_US``."""
    return _merged(sketches, keys, F.lit(RUN_START_US).cast("bigint"), k)


def sketch_quantiles(
    sketches: DataFrame, keys: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """``(keys, start_us, samples, quantile, value)`` of each sketch; values are samples' own."""
    if not all(0 < q <= 1 for q in quantiles):
        raise ValueError("quantiles must be above 0 and at most 1")
    qs = F.array(*[F.lit(float(q)) for q in quantiles])
    values = F.kll_sketch_get_quantile_bigint("sketch", qs)
    found = sketches.select(*keys, "start_us", "samples", F.explode(F.arrays_zip(qs.alias("q"), values.alias("v"))).alias("e"))
    return found.select(*keys, "start_us", "samples", F.col("e.q").alias("quantile"), F.col("e.v").alias("value"))


def ranks(found: DataFrame, counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles with ``below`` and ``up_to``, the exact shares of samples below and up to the value.

    ``counts`` has ``(keys, start_us, value, n)``, a row per distinct value. Rows with a null
    key or start are left out.
    """
    other = counts.select(*keys, "start_us", F.col("value").alias("sample"), "n")
    met = found.join(other, [*keys, "start_us"])
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")
    return met.groupBy(*keys, "start_us", "samples", "quantile", "value").agg(
        share(F.col("sample") < F.col("value")).alias("below"), share(F.col("sample") <= F.col("value")).alias("up_to")
    )
