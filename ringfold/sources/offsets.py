"""Progress logs: ``{topic: {partition: offset}}`` per micro-batch, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OFFSET_LINE = 3


def _required(value: Column, message: str) -> Column:
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(message)))


def explode_offsets(log: DataFrame) -> DataFrame:
    """``(batch_id, json)`` to ``(batch_id, topic, partition, offset)``.

    Anything but a map of maps of numbers is an error.
    """
    topics = F.from_json("json", "map<string, map<string, bigint>>")
    bad = "illegal offset data"
    return (
        log.select("batch_id", F.explode(_required(topics, bad)).alias("topic", "offsets"))
        .select("batch_id", "topic", F.explode(_required(F.col("offsets"), bad)).alias("partition", "offset"))
        .select(
            "batch_id",
            "topic",
            F.col("partition").cast("int").alias("partition"),
            _required(F.col("offset"), bad).alias("offset"),
        )
    )


def latest_offsets(offsets: DataFrame) -> DataFrame:
    """The offset of the newest batch for each partition of each topic."""
    return offsets.groupBy("topic", "partition").agg(
        F.max("batch_id").alias("batch_id"), F.max_by("offset", "batch_id").alias("offset")
    )


def read_offset_log(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The offset files of a streaming checkpoint as ``(batch_id, json)``.

    Files are named by their batch number; other names are skipped. The offsets
    stand on the third line, below a version and a metadata line.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    files = spark.read.text(f"{checkpoint.rstrip('/')}/offsets", wholetext=True).select(name.alias("name"), "value")
    lines = F.split("value", "\n")
    return files.where(F.col("name").rlike("^[0-9]+$")).select(
        F.col("name").cast("bigint").alias("batch_id"), F.get(lines, F.lit(OFFSET_LINE - 1)).alias("json")
    )
