"""Commit records, sinks that publish whole micro-batches, start marks, rule versions, counters."""

import os

import pytest
from pyspark.sql import functions as F

from ringfold.commits import CommitLog
from ringfold.operators.digest import running_count_events
from ringfold.operators.rules import place_rules, rule_slots
from ringfold.sources.manifest import ManifestSink, read_published
from ringfold.sources.streams import arriving_file_records
from ringfold.streaming.changes import ChangingRules, RuleVersions
from ringfold.streaming.counts import CountSink

IDS = "id bigint"


def test_first_text_stays(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.get("a") is None and log.texts() == []
    assert log.put("b", "2") == "2" and log.put("a", "é") == "é"
    assert log.put("a", "3") == "é"
    assert CommitLog(spark, str(tmp_path / "log")).texts() == ["é", "2"]


class Stopped(Exception):
    pass


class StopsBeforePublishing(ManifestSink):
    def publish(self, log, name, folder):
        raise Stopped


def numbers(spark, path):
    return sorted(r.id for r in read_published(spark, path, IDS).collect())


def test_batch_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "events")
    assert numbers(spark, path) == []
    ManifestSink(path)(spark.range(3), 0)
    with pytest.raises(Stopped):
        StopsBeforePublishing(path)(spark.range(3, 5), 1)
    assert len(os.listdir(f"{path}/batches")) == 2
    assert numbers(spark, path) == [0, 1, 2]
    ManifestSink(path)(spark.range(3, 5), 1)
    # a batch that is run again changes nothing, whatever a reader has open
    ManifestSink(path)(spark.range(9, 12), 0)
    assert numbers(spark, path) == [0, 1, 2, 3, 4]
    ManifestSink(path)(spark.range(0), 2)
    assert numbers(spark, path) == [0, 1, 2, 3, 4]


def put_file(spark, folder, name, ids, seconds):
    spark.createDataFrame([(i,) for i in ids], IDS).toPandas().to_parquet(folder / name)
    os.utime(folder / name, (seconds, seconds))


def arrived(spark, folder, mark, out):
    stream = arriving_file_records(spark, str(folder), spark.range(0).schema, str(mark), pattern="*.parquet", max_per_trigger=1)
    query = stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").format("parquet").trigger(availableNow=True)
    query.start(f"{out}/rows").awaitTermination()
    return sorted(r.id for r in spark.read.schema(IDS).parquet(f"{out}/rows").collect())


def test_files_that_were_there_are_skipped(spark, tmp_path):
    folder, mark, out = tmp_path / "in", tmp_path / "mark", tmp_path / "out"
    folder.mkdir()
    put_file(spark, folder, "a.parquet", [1], 1000)
    put_file(spark, folder, "b.parquet", [2], 2000)
    assert arrived(spark, folder, mark, out) == []
    put_file(spark, folder, "c.parquet", [3], 2000)
    put_file(spark, folder, "d.parquet", [4], 3000)
    assert arrived(spark, folder, mark, out) == [3, 4]
    # the mark is that of the first start, also without the stream's own checkpoint
    assert arrived(spark, folder, mark, tmp_path / "again") == [3, 4]


def test_empty_folder_has_no_mark(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    assert arrived(spark, folder, tmp_path / "mark", tmp_path / "out") == []
    put_file(spark, folder, "a.parquet", [1], 1000)
    assert arrived(spark, folder, tmp_path / "mark", tmp_path / "out") == [1]


def rules(spark, **selectivity):
    rows = spark.createDataFrame([(int(k[1:]), s) for k, s in selectivity.items()], "rule_no bigint, selectivity double")
    return place_rules(rows, 1)


def test_replay_takes_the_rules_it_took(spark, tmp_path):
    versions = RuleVersions(spark, str(tmp_path / "rules"))
    with pytest.raises(ValueError):
        versions.latest()
    assert versions.publish(rules(spark, r1=1.0)) == 0
    seen = {}

    def then(matches, batch_id):
        seen[batch_id] = {r.rule_id for r in matches.collect()}

    run = ChangingRules(versions.path, str(tmp_path / "job"), then)
    records = spark.range(5).select(F.col("id").alias("record_id"), F.lit(None).cast("timestamp").alias("ts"), F.lit(7).cast("bigint").alias("position"), F.lit(0).cast("bigint").alias("first_long"))
    run(records, 0)
    first = seen[0]
    assert len(first) == 1
    assert versions.publish(rules(spark, r1=0.0, r2=1.0, r3=1.0)) == 1
    run(records, 1)
    run(records, 0)
    assert seen[0] == first and len(seen[1]) == 2 and not first & seen[1]


@pytest.mark.parametrize("max_rows", [1 << 22, 20])
def test_counters_of_batches_equal_those_of_all_rows(spark, tmp_path, max_rows):
    """A rule with most rows, which is split under the small bound, several events a batch, and a replay."""
    rows = spark.range(300).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 4)).alias("rule_id"),
        F.timestamp_seconds("id").alias("ts"),
        F.col("id").alias("record_id"),
    )
    sink = CountSink(str(tmp_path), 4, max_rows=max_rows)
    for i, (a, b) in enumerate([(0, 90), (90, 90), (90, 101), (101, 300)]):
        batch = rows.where(f"record_id >= {a} AND record_id < {b}")
        sink(batch, i)
        sink(batch, i)
    fields = ["rule_id", "n", "record_id"]
    got = spark.read.parquet(sink.events).select(fields).collect()
    want = running_count_events(rows, 4).select(fields).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 60


def test_slots_of_wide_rules_in_chunks(spark):
    """More slots than a chunk holds: each is there once."""
    got = rule_slots(rules(spark, r1=1.0, r2=0.7), 18).groupBy("rule_no").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("top"))
    found = {r.rule_no: (r.n, r.d, r.top) for r in got.collect()}
    assert found[1] == (1 << 18, 1 << 18, (1 << 18) - 1)
    assert found[2][0] == found[2][1] and abs(found[2][0] - 0.7 * (1 << 18)) < 3
