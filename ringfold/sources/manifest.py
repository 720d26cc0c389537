"""An event sink whose micro-batches become visible as a whole.

The rows of a micro-batch go to a folder of their own, which a commit record then
publishes. Readers follow the records, so rows of a batch that is being written, or was
given up, are never read, and published rows are never touched again.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ringfold.commits import CommitLog


class ManifestSink:
    """Micro-batch function. A batch that is published already is left as it is."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        log = commits(batch.sparkSession, self.path)
        name = f"{batch_id:019}"
        if log.get(name) is None:
            folder = f"batches/{batch_id}-{uuid.uuid4().hex}"
            batch.write.parquet(f"{self.path}/{folder}")
            self.publish(log, name, folder)

    def publish(self, log: CommitLog, name: str, folder: str) -> None:
        log.put(name, folder)


def commits(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, f"{path.rstrip('/')}/commits")


def read_published(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all published micro-batches; a batch that is published later is not in it."""
    folders = [f"{path.rstrip('/')}/{folder}" for folder in commits(spark, path).texts()]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def write_published(
    events: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] | None = None
) -> StreamingQuery:
    """Write an event stream to a folder, to be read by :func:`read_published`."""
    return (
        events.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(ManifestSink(path))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
