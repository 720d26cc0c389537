"""Registered queries: sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.functions.payload import event_pack, leading_long
from ringfold.functions.timing import epoch_ms
from ringfold.plans import sql
from ringfold.plans import views as v
from ringfold.plans.shared import drain, event_stream, register
from ringfold.sources.manifest import read_published, write_published
from ringfold.sources.offsets import explode_offsets, latest_offsets
from ringfold.sources.records import pace, random_bytes
from ringfold.sources.streams import write_events
from ringfold.workdir import work_dir

@register("stream_source", "SELECT event_id AS record_id, epoch_us(ts) AS ts_us, md5(event_id::VARCHAR) AS data FROM events")
def stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drain(v.event_records(event_stream(spark, sf_dir)), "stream-source")
    return rows.select("record_id", F.unix_micros("ts").alias("ts_us"), F.lower(F.hex("data")).alias("data"))


def _user_events(events: DataFrame) -> DataFrame:
    """Each event as a keyed event of 40 bytes."""
    records = v.event_records(events)
    value = event_pack(
        F.lit(1), leading_long(F.col("data")), F.lit(0), F.coalesce(epoch_ms(F.col("ts")), F.lit(0)), F.substring("data", 1, 5), 40
    )
    return records.select(F.concat(F.lit("record_"), F.col("record_id")).alias("key"), value.alias("value"))


EVENT_ROWS = f"""
SELECT 'record_' || record_id AS key,
       '0000000000000001' || substr(data, 1, 16) || '0000000000000000'
         || upper({sql.hex_long(sql.MS_OR_0)}) || substr(data, 1, 10) || '000000' AS value
FROM rec"""


@register("event_sink", sql.query(sql.REC_EVENTS, select=EVENT_ROWS))
def event_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "event-sink")
    write_events(_user_events(event_stream(spark, sf_dir)), f"{path}/events", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/events").select("key", F.hex("value").alias("value"))


@register("event_sink_published", sql.query(sql.REC_EVENTS, select=EVENT_ROWS))
def event_sink_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "event-sink")
    events = _user_events(event_stream(spark, sf_dir))
    write_published(events, f"{path}/events", f"{path}/checkpoint").awaitTermination()
    return read_published(spark, f"{path}/events", events.schema).select("key", F.hex("value").alias("value"))


def _random_hex(size: int, source: str, number: str) -> str:
    blocks = " || ".join(f"md5('bench:' || {source} || ':' || {number} || ':{b}')" for b in range(-(-size // 16)))
    return f"substr({blocks}, 1, {2 * size})"


@register(
    "generate_records",
    f"SELECT o_orderkey AS record_id, {_random_hex(40, 'o_custkey % 4', 'o_orderkey')} AS data FROM orders",
)
def generate_record_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = random_bytes("bench", F.col("o_custkey") % 4, F.col("o_orderkey"), 40)
    return v.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.lower(F.hex(data)).alias("data")
    )


@register(
    "paced_records",
    f"""
SELECT o_orderkey AS record_id, o_orderkey % 4 AS source,
       1704067200000000 + (o_orderkey // 4 + 1) * 333333333 // 1000 AS ts_us,
       {_random_hex(24, '(o_orderkey % 4)', 'o_orderkey')} AS data
FROM orders""",
)
def paced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    paced = pace(v.table(spark, sf_dir, "orders"), "o_orderkey", 4, 3, v.DOC_EPOCH_US)
    data = random_bytes("bench", F.col("source"), F.col("o_orderkey"), 24)
    return paced.select(F.col("o_orderkey").alias("record_id"), "source", "ts_us", F.lower(F.hex(data)).alias("data"))


@register("offset_log", sql.query(sql.OFFSET_LOG, select='SELECT batch_id, topic, partition, "offset" FROM exploded'))
def offset_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_offsets(v.offset_log(spark, sf_dir))


@register(
    "offset_latest",
    sql.query(
        sql.OFFSET_LOG,
        select="""
SELECT topic, partition, max(batch_id) AS batch_id, max_by("offset", batch_id) AS "offset"
FROM exploded GROUP BY topic, partition""",
    ),
)
def offset_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_offsets(explode_offsets(v.offset_log(spark, sf_dir)))
