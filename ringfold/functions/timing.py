"""Time columns: epoch milliseconds and delivery latency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp, truncated."""
    return F.unix_millis(ts.cast("timestamp"))


def latency_ms(append_ms: Column, end_ms: Column) -> Column:
    """Time from the record that fired an event to the event's arrival."""
    return append_ms - end_ms


def latency_sign(latency: Column) -> Column:
    """Clock skew can make a latency negative; such samples are measured apart."""
    return F.when(latency >= 0, F.lit("latency")).otherwise(F.lit("negative"))
