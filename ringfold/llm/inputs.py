"""Reading the tables of the training-data queries, and columns that operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch. Texts can be long, so a batch is some hundreds of them.
BATCH_ROWS = 640


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Sets the session's Arrow batch size, and when shuffle files go; see :func:`small_batches`."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound a Python worker's memory, and remove the shuffle files of a query once it has run.

    Operators run many queries one after another. Without it their shuffle files stay until
    the driver happens to collect its garbage.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")
