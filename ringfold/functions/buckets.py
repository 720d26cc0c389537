"""Histogram buckets for arbitrary, sorted upper bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_bounds(bounds: Sequence[float]) -> list[float]:
    bounds = [float(b) for b in bounds]
    if not bounds or any(b >= c for b, c in zip(bounds, bounds[1:])):
        raise ValueError("bucket bounds must be strictly increasing and not empty")
    return bounds


def bucket_index(value: Column, bounds: Sequence[float]) -> Column:
    """Index of the first bound that is not below ``value``; ``len(bounds)`` beyond the last.

    A balanced tree of comparisons, so a row costs log2(len(bounds)) of them.
    """
    bounds = check_bounds(bounds)

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(bounds[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))

    return between(0, len(bounds))
