"""The registry of queries, and what several of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.operators.digest import SplitMatches
from ringfold.operators.fanout import match_records
from ringfold.plans import sql
from ringfold.plans import views as v
from ringfold.plans.dataflow import digest_records, large_matches
from ringfold.sources.streams import file_records
from ringfold.streaming.match import stream_match
from ringfold.workdir import work_dir

Query = Callable[[SparkSession, str], DataFrame]

EVERY = 10
PAYLOAD_STATE = 64

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _QUERIES[name] = query
        if oracle:
            _SQL[name] = oracle
        return query

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def digests(records: DataFrame, rules: DataFrame, *args, **options) -> DataFrame:
    return digest_records(records, rules, *args, hash=v.HASH, **options)


def digest_fields(digests: DataFrame) -> DataFrame:
    return digests.select("rule_id", "cycle", "n", "n_records", "total", "start_ms", "end_ms")


def event_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_records(v.prepared(v.rec_events(spark, sf_dir)), v.subscriptions(spark, sf_dir))


EVENT_MATCHES = (sql.REC_EVENTS, sql.PREPARED, sql.subscriptions(), sql.MATCHES)


#: Micro-batches that a stream of events comes in at least, and the rows of one beyond which there are more.
SLICES = 6
SLICE_ROWS = 1 << 20
#: Rows of a file; a micro-batch of more is read, and fanned out, by a task per file.
FILE_ROWS = 1 << 16
#: Modification time of a stream's first file.
FIRST_FILE_MS = 1_704_067_200_000


def slicing(n_events: int, n_rules: int, slices: int = SLICES) -> tuple[int, int]:
    """Micro-batches of a stream, and files of each.

    A micro-batch reads the rule index and rewrites the rules' state, so a full one has no
    fewer rows than there are rules: that part of the work then grows with the input, not
    with the product of events and rules.
    """
    batches = max(slices, -(-n_events // max(SLICE_ROWS, n_rules)))
    return batches, max(1, -(-n_events // (batches * FILE_ROWS)))


def event_slices(
    spark: SparkSession, sf_dir: str, where: Column | None = None, slices: int = SLICES
) -> tuple[list[str], int]:
    """Write all rows of ``events``, or those of a condition, as files in arrival order, rows without a time first; return their names, and the files of a micro-batch.

    The table is cut by ranges of (ts, event_id), a task per file, so files are of bounded
    size and no file holds rows that come before those of an earlier one. Tables with few
    rows may give fewer files, and an empty one gives one empty file.
    """
    events = v.table(spark, sf_dir, "events")
    if where is not None:
        events = events.where(where)
    path = work_dir(spark, "event-files")
    batches, width = slicing(events.count(), v.table(spark, sf_dir, "customer").count(), slices)
    keys = [F.asc_nulls_first(c) for c in ("ts", "event_id")]
    events.repartitionByRange(batches * width, *keys).write.parquet(path)
    return sorted(f for f in spark.read.parquet(path).inputFiles()), width


def event_files(spark: SparkSession, sf_dir: str, where: Column | None = None, slices: int = SLICES) -> list[str]:
    """The files of :func:`event_slices`."""
    return event_slices(spark, sf_dir, where, slices)[0]


def publish(spark: SparkSession, files: list[str], path: str) -> str:
    """Move files into the folder of a stream, which takes them up in this order."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(folder)
    there = len(fs.listStatus(folder))
    for i, name in enumerate(files, there):
        target = jvm.org.apache.hadoop.fs.Path(folder, f"{i:09}.parquet")
        fs.rename(jvm.org.apache.hadoop.fs.Path(name), target)
        # the source orders files by this time
        fs.setTimes(target, FIRST_FILE_MS + 1000 * i, -1)
    return path


def event_stream(spark: SparkSession, sf_dir: str, path: str | None = None, width: int = 1) -> DataFrame:
    """The events as a stream, ``width`` files per micro-batch."""
    if path is None:
        files, width = event_slices(spark, sf_dir)
        path = publish(spark, files, work_dir(spark, "event-stream"))
    schema = v.table(spark, sf_dir, "events").schema
    return file_records(spark, path, schema, pattern="*.parquet", max_per_trigger=width)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-only stream over all its input, into a folder, and read that."""
    path = work_dir(stream.sparkSession, name)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{path}/rows")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def stream_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = v.prepared(v.event_records(event_stream(spark, sf_dir)))
    return stream_match(records, v.subscriptions(spark, sf_dir))


def sized(matches: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame | SplitMatches:
    return large_matches(matches, v.table(spark, sf_dir, "events").count())
