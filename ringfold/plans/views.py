"""Inputs of the registered queries, derived from the given tables.

Each view reads whole tables and has a definition in SQL next to it in ``sql.py``. The
md5 hash is used throughout, since every SQL engine has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ringfold.functions.timing import epoch_ms
from ringfold.operators.fanout import prepare_records
from ringfold.operators.rules import place_rules, zipf_selectivities

HASH = "md5"
SEED = "seed"
DIGITS = 12
DOC_EPOCH_US = 1_704_067_200_000_000
SAMPLE_RATE = 0.02


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its timestamps carry no zone and are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_records(events: DataFrame) -> DataFrame:
    """``(record_id, ts, data)``: 16 evenly distributed bytes per event."""
    return events.select(
        F.col("event_id").alias("record_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unhex(F.md5(F.col("event_id").cast("string").cast("binary"))).alias("data"),
    )


def rec_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_records(table(spark, sf_dir, "events"))


def rec_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts as records: lengths differ, prefixes repeat. One second apart."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("record_id"),
        F.timestamp_micros(F.lit(DOC_EPOCH_US) + F.col("doc_id") * 1_000_000).alias("ts"),
        F.encode("text", "utf-8").alias("data"),
    )


def padded_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, those below the 8 bytes that a digest needs filled up with zeros."""
    padded = F.when(F.length("data") < 8, F.rpad("data", 8, F.lit(b"\0"))).otherwise(F.col("data"))
    return rec_docs(spark, sf_dir).withColumn("data", padded)


def subscriptions(spark: SparkSession, sf_dir: str, total: float = 5.0, s: float = 1.0) -> DataFrame:
    """A rule table with one rule per customer."""
    numbers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule_no"))
    return place_rules(zipf_selectivities(numbers, total, s, DIGITS), SEED, HASH)


def scan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling rules with a seed each, one per nation; they have no index."""
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("sample_"), F.col("n_nationkey").cast("string")).alias("rule_id"),
        F.col("n_nationkey").cast("bigint").alias("seed"),
        F.lit(SAMPLE_RATE).alias("rate"),
    )


def prepared(records: DataFrame, **options) -> DataFrame:
    return prepare_records(records, hash=HASH, **options)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an arrival time: between -500 and 11,499 ms after they end."""
    ms = epoch_ms(F.col("ts"))
    delay = F.col("event_id") * 7919 % 12000 - 500
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), ms.alias("end_ms"), (ms + delay).alias("append_ms")
    )


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    even = F.col("event_id") % 2 == 0
    return (
        table(spark, sf_dir, "events")
        .groupBy(hour.alias("ts"))
        .agg(
            F.count("*").alias("n"),
            F.count(F.when(F.col("event_id") % 50 != 0, 1)).alias("done"),
            F.count(F.when(even, 1)).alias("n0"),
            F.count(F.when(~even, 1)).alias("n1"),
        )
    )


def _running(column: str):
    # one row per hour, so the window without a key stays small
    return F.sum(column).over(W.orderBy("ts").rowsBetween(W.unboundedPreceding, 0))


def lag_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hour: records offered so far, and those of them taken over."""
    return _hours(spark, sf_dir).select(
        "ts",
        F.lit("input").alias("topic"),
        F.lit(0).alias("partition"),
        _running("n").alias("end_offset"),
        _running("done").alias("committed_offset"),
    )


def partition_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event: how far its type's partition of a topic has come, set back now and then."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("topic"), (F.col("user_id") % 2).cast("string")).alias("topic"),
        F.length("event_type").alias("partition"),
        (F.col("event_id") * 10 - F.when(F.col("event_id") % 97 == 0, 5000).otherwise(0)).alias("committed_offset"),
    )


def offset_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hour a progress entry with the offsets of two partitions."""
    hour = F.unix_seconds("ts") / 3600
    entry = F.format_string('{"input":{"0":%d,"1":%d}}', _running("n0"), _running("n1"))
    return _hours(spark, sf_dir).select(hour.cast("bigint").alias("batch_id"), entry.alias("json"))
