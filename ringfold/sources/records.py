"""Reproducible random records and paced arrival times.

No generator state is carried from row to row: every byte follows from the seed,
the source and the row's number, so any partitioning gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 16
NANOS_PER_SECOND = 1_000_000_000


def random_bytes(seed: str, source: Column, number: Column, size: int) -> Column:
    """``size`` uniformly distributed bytes for row ``number`` of a source."""
    if size < 1:
        raise ValueError("record size must be at least 1 byte")
    blocks = [
        F.md5(
            F.concat_ws(":", F.lit(seed), source.cast("string"), number.cast("string"), F.lit(str(block))).cast(
                "binary"
            )
        )
        for block in range(-(-size // BLOCK_BYTES))
    ]
    return F.unhex(F.substring(F.concat(*blocks), 1, 2 * size))


def generate_records(
    spark: SparkSession, n: int, size: int = 1024, seed: str = "records-0", source: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """``n`` random records ``(record_id, data)`` of one source."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return ids.select(
        F.col("id").alias("record_id"), random_bytes(seed, F.lit(source), F.col("id"), size).alias("data")
    )


def pace(numbers: DataFrame, number: str, sources: int, per_second: float, start_us: int) -> DataFrame:
    """Give each row a source and the time at which that source sends it.

    Rows go round-robin to the sources. A source fires every ``floor(1e9 / rate)``
    nanoseconds, the first time after one such delay.
    """
    if sources < 1 or per_second <= 0:
        raise ValueError("sources and per_second must be positive")
    delay_ns = int(NANOS_PER_SECOND / per_second)
    return numbers.select(
        "*",
        (F.col(number) % sources).alias("source"),
        F.expr(f"{start_us}L + ({number} div {sources} + 1) * {delay_ns}L div 1000").alias("ts_us"),
    )


def paced_records(
    spark: SparkSession, n: int, sources: int = 1, per_second: float = 1000, size: int = 1024,
    seed: str = "records-0", start_us: int = 0,
) -> DataFrame:
    """Batch form of a paced load: ``(record_id, source, ts, data)``."""
    paced = pace(spark.range(n).withColumnRenamed("id", "record_id"), "record_id", sources, per_second, start_us)
    return paced.select(
        "record_id",
        "source",
        F.timestamp_micros("ts_us").alias("ts"),
        random_bytes(seed, F.col("source"), F.col("record_id"), size).alias("data"),
    )


def paced_stream(
    spark: SparkSession, sources: int = 1, per_second: int = 1000, size: int = 1024,
    seed: str = "records-0", seconds_per_batch: int = 1,
) -> DataFrame:
    """Live form of a paced load: each micro-batch holds the rows of its time span."""
    rows = sources * per_second * seconds_per_batch
    ticks = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", rows)
        .option("advanceMillisPerBatch", 1000 * seconds_per_batch)
        .load()
    )
    source = F.col("value") % F.lit(sources)
    return ticks.select(
        F.col("value").alias("record_id"),
        source.alias("source"),
        F.col("timestamp").alias("ts"),
        random_bytes(seed, source, F.col("value"), size).alias("data"),
    )
