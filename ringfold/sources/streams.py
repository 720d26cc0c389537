"""Record streams in, keyed events out."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ringfold.commits import CommitLog

DELIVERIES = ("none", "at_least_once", "exactly_once")
OFFSET_BITS = 44
ISOLATIONS = ("read_uncommitted", "read_committed")


def kafka_options(
    servers: str,
    topic: str,
    starting: str | Mapping[str, Mapping[str, int]] = "latest",
    max_per_trigger: int | None = None,
    isolation: str | None = None,
) -> dict[str, str]:
    """Options of a Kafka record stream.

    ``starting`` is ``latest``, ``earliest`` or ``{topic: {partition: offset}}``;
    ``max_per_trigger`` caps the records of one micro-batch.
    """
    if not isinstance(starting, str):
        starting = json.dumps({t: dict(p) for t, p in starting.items()}, sort_keys=True)
    elif starting not in ("latest", "earliest"):
        raise ValueError(f"starting must be latest, earliest or a map of offsets, not {starting!r}")
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(_positive(max_per_trigger))
    if isolation is not None:
        if isolation not in ISOLATIONS:
            raise ValueError(f"isolation must be one of {ISOLATIONS}, not {isolation!r}")
        options["kafka.isolation.level"] = isolation
    return options


def file_options(
    starting: str = "earliest",
    max_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
    max_age: str | None = None,
    pattern: str | None = None,
) -> dict[str, str]:
    """Options of a file record stream.

    ``latest`` reads the newest files first; ``max_age`` (such as ``7d``) skips older ones.
    A micro-batch is capped by files or by bytes.
    """
    if max_per_trigger is not None and max_bytes_per_trigger is not None:
        raise ValueError("cap a micro-batch by files or by bytes, not both")
    if starting not in ("latest", "earliest"):
        raise ValueError(f"starting must be latest or earliest, not {starting!r}")
    options = {"latestFirst": str(starting == "latest").lower()}
    if max_per_trigger is not None:
        options["maxFilesPerTrigger"] = str(_positive(max_per_trigger))
    if max_bytes_per_trigger is not None:
        options["maxBytesPerTrigger"] = str(_positive(max_bytes_per_trigger))
    if max_age is not None:
        options["maxFileAge"] = max_age
    if pattern is not None:
        options["pathGlobFilter"] = pattern
    return options


def _positive(n: int) -> int:
    if n < 1:
        raise ValueError(f"a micro-batch cap must be at least 1, not {n}")
    return n


def record_columns(messages: DataFrame) -> DataFrame:
    """Messages of a topic as records: bytes, log-append time, and a number from their place.

    Partition and offset make the number unique, and rising with arrival in a partition.
    """
    record_id = F.shiftleft(F.col("partition").cast("bigint"), OFFSET_BITS) + F.col("offset")
    return messages.select(record_id.alias("record_id"), F.col("timestamp").alias("ts"), F.col("value").alias("data"))


def kafka_records(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Record stream of a topic."""
    return record_columns(spark.readStream.format("kafka").options(**kafka_options(servers, topic, **options)).load())


def file_records(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """Record stream of a folder of parquet files, in the order they arrive."""
    return spark.readStream.schema(schema).options(**file_options(**options)).parquet(path)


def arriving_file_records(spark: SparkSession, path: str, schema: StructType, mark: str, **options) -> DataFrame:
    """Record stream of the files that come into a folder after the stream's first start.

    The time of the newest file there is stored below ``mark`` at the first start, with the
    names of the files of that time, and holds for all later starts. A file that is moved
    in with an older time counts as there before. Micro-batches over older files are empty.
    """
    listed = spark.read.format("binaryFile").options(**file_options(**options)).load(path)
    log = CommitLog(spark, mark)
    start = log.get("start") or log.put("start", json.dumps(_newest(listed)))
    newest, names = json.loads(start)
    records = file_records(spark, path, schema, **options)
    if newest is None:
        return records
    at, name = F.unix_millis("_metadata.file_modification_time"), F.col("_metadata.file_name")
    return records.where((at > newest) | ((at == newest) & ~name.isin(names))).select(*schema.names)


def _newest(listed: DataFrame) -> tuple[int | None, list[str]]:
    files = listed.select("_metadata.file_name", F.unix_millis("_metadata.file_modification_time").alias("at"))
    newest = files.agg(F.max("at")).first()[0]
    return newest, [] if newest is None else sorted(r[0] for r in files.where(F.col("at") == newest).collect())


def write_batch(df: DataFrame, path: str, batch_id: int, delivery: str = "exactly_once") -> None:
    """Store the events of one micro-batch.

    ``exactly_once`` replaces the batch's own folder, so a replayed batch leaves the
    same rows; the other levels append, so a replay may repeat them.
    """
    _check_delivery(delivery)
    if delivery == "exactly_once":
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    else:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").partitionBy("batch_id").parquet(path)


def _check_delivery(delivery: str) -> None:
    if delivery not in DELIVERIES:
        raise ValueError(f"delivery must be one of {DELIVERIES}, not {delivery!r}")


def write_events(
    events: DataFrame,
    path: str,
    checkpoint: str,
    delivery: str = "exactly_once",
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Write a keyed event stream to a folder, in update mode, with a checkpoint."""
    _check_delivery(delivery)
    return (
        events.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch_id: write_batch(df, path, batch_id, delivery))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def kafka_sink_options(servers: str, topic: str, checkpoint: str, delivery: str = "at_least_once") -> dict[str, str]:
    """Options of a Kafka event sink, which can promise at-least-once and no more."""
    _check_delivery(delivery)
    if delivery == "exactly_once":
        raise ValueError("a Kafka sink delivers at least once; use the file sink for exactly_once")
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint}
    options["kafka.acks"] = "0" if delivery == "none" else "all"
    return options


def write_events_kafka(events: DataFrame, servers: str, topic: str, checkpoint: str, **options) -> StreamingQuery:
    """Write ``(key, value)`` events to a topic."""
    return (
        events.select("key", "value")
        .writeStream.outputMode("update")
        .format("kafka")
        .options(**kafka_sink_options(servers, topic, checkpoint, **options))
        .start()
    )
