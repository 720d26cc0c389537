"""Windows of rules that match large shares of the records: as from matches, without a row per match."""

from functools import partial

import pytest
from oracle import compare, tables
from pyspark.sql import functions as F

from ringfold.functions.ring import RING_MASK, arc_width
from ringfold.operators import dense
from ringfold.operators.dense import DENSE_COLUMNS, DenseMatches, dense_levels, dense_rules, dense_windows
from ringfold.operators.fanout import match_records
from ringfold.plans import catalog
from ringfold.plans import views as v
from ringfold.streaming import digest
from ringfold.streaming.digest import DigestSink

N_RECORDS, N_RULES, EVERY = 3000, 120, 7


@pytest.fixture(scope="module")
def wide(spark):
    """Records in three batches, some without a time, a position or a place of their own, and rules also across the ring's end."""
    position = F.when(F.col("id") % 50 == 0, RING_MASK).when(F.col("id") % 50 == 1, None).otherwise(F.xxhash64("id").bitwiseAND(F.lit(RING_MASK)))
    records = spark.range(N_RECORDS, numPartitions=3).select(
        F.col("id").alias("record_id"),
        F.when(F.col("id") % 3 > 0, F.timestamp_millis(F.col("id") % 40 * 977 - 5000)).alias("ts"),
        position.alias("position"),
        F.xxhash64("id", F.lit(1)).alias("first_long"),
        (F.col("id") % 3).alias("batch"),
    )
    offset = F.when(F.col("id") < 20, RING_MASK - F.col("id")).otherwise(F.xxhash64("id", F.lit(2)).bitwiseAND(F.lit(RING_MASK)))
    selectivity = F.element_at(F.array(*[F.lit(x) for x in (0.0039, 0.0625, 0.03, 0.0, 0.002)]), (F.col("id") % 5 + 1).cast("int"))
    rules = spark.range(N_RULES).select(
        F.concat(F.lit("r"), "id").alias("rule_id"), offset.alias("offset"), arc_width(selectivity).alias("width")
    )
    return records.localCheckpoint(), rules.localCheckpoint()


def digests(spark, sink):
    return sorted(tuple(r) for r in spark.read.parquet(sink.events).drop("batch_id", "payload").collect())


@pytest.mark.parametrize("group_pairs", [dense.GROUP_PAIRS, 300])
def test_windows_are_those_of_the_matches(spark, wide, monkeypatch, tmp_path, group_pairs):
    monkeypatch.setattr(dense, "DENSE_LEVEL", 4)
    monkeypatch.setattr(digest, "dense_windows", partial(dense_windows, group_pairs=group_pairs))
    records, rules = wide
    levels = dense_levels(rules, 0.0)
    assert levels == [4, 8]
    folded, plain = DigestSink(str(tmp_path / "dense"), EVERY), DigestSink(str(tmp_path / "plain"), EVERY)
    placed = dense_rules(rules, levels)
    for batch_id in range(3):
        own = records.where(F.col("batch") == batch_id).select(*sorted(DENSE_COLUMNS))
        matches = match_records(own, rules)
        plain(matches, batch_id)
        for _ in range(2):  # a batch that is run again leaves the same rows
            folded(DenseMatches(matches.where("false"), own, placed, levels), batch_id)
    found = digests(spark, folded)
    assert found == digests(spark, plain) and len({r[0] for r in found}) > 60


def test_no_row_per_match(spark, wide):
    records, rules = wide
    rules = rules.withColumn("width", arc_width(F.lit(0.0039)))
    matches = match_records(records.drop("batch"), rules)
    handed = DenseMatches(matches.where("false"), records, dense_rules(rules, [8]), [8])
    seen = spark.createDataFrame([("r1", 3)], "rule_id string, seen bigint")
    rows = dense_windows(handed, seen, EVERY).collect()
    n_matches = matches.count()
    assert sum(r["weight"] for r in rows) == n_matches
    assert len(rows) <= n_matches // EVERY + 2 * N_RULES and sum(not r["whole"] for r in rows) <= 2 * N_RULES


def test_few_matches_are_made_as_rows(spark, wide):
    assert dense_levels(wide[1], dense.DENSE_SHARE) == []
    many = wide[1].crossJoin(spark.range(50)).withColumn("width", arc_width(F.lit(0.002)))
    assert dense_levels(many, dense.DENSE_SHARE) == [8]


def test_rules_change_to_dense_ones_in_a_stream(spark, small_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(dense, "DENSE_SHARE", 0.0)
    monkeypatch.setattr(dense, "DENSE_LEVEL", 4)
    kept, called = [], DigestSink.__call__

    def call(self, batch, batch_id):
        kept.append(type(batch))
        called(self, batch, batch_id)

    monkeypatch.setattr(DigestSink, "__call__", call)
    con = tables(small_dir)
    for name in ("customer", "nation"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    timeless = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS ts"
    con.execute(f"COPY (SELECT * REPLACE ({timeless}) FROM events) TO '{tmp_path}/events.parquet'")
    path, name = str(tmp_path), "stream_rule_changes"
    assert compare(catalog.queries()[name](spark, path), tables(path), catalog.oracle_sql()[name]) is None
    assert set(kept) == {DenseMatches}


def test_records_with_more_than_the_fixed_fields_take_the_plain_way(spark, small_dir):
    assert set(v.prepared(v.rec_events(spark, small_dir)).columns) <= DENSE_COLUMNS
    assert not set(v.prepared(v.rec_events(spark, small_dir), random_phase=True).columns) <= DENSE_COLUMNS
