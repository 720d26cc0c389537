"""Shared folder for streaming checkpoints and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's ``spark.checkpoint.dir``.

    A machine-local folder is only used by a local session that names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ringfold-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps then read the stored rows instead of running the plan again, also
    after an executor is lost.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, *more: DataFrame) -> None:
    """Delete the rows of tables from `stored` that no later step reads any more."""
    folders = {name.rsplit("/", 1)[0] for table in (df, *more) for name in table.inputFiles()}
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)
