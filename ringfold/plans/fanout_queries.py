"""Registered queries: the fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.functions.ring import hash_sample
from ringfold.operators.fanout import match_records, predicate_fanout, ring_range_join, scan_fanout
from ringfold.plans import sql
from ringfold.plans import views as v
from ringfold.plans.shared import EVENT_MATCHES, drain, event_stream, register, stream_matches
from ringfold.streaming.match import stream_match

@register("ring_range_join", sql.query(*EVENT_MATCHES, select="SELECT rule_id, record_id FROM matches"))
def ring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = v.prepared(v.rec_events(spark, sf_dir))
    return ring_range_join(records, v.subscriptions(spark, sf_dir)).select("rule_id", "record_id")


def sampling_rule(record: Callable[[str], Column], rule: Column) -> Column:
    """Predicate of a rule with its own hash seed and rate."""
    return hash_sample(record("data"), rule["seed"], rule["rate"], v.HASH)


SCANNED = f"""
scanned AS (
  SELECT 'sample_' || n_nationkey AS rule_id, record_id FROM rec, nation
  WHERE {sql.sampled('data', 'n_nationkey', f'{v.SAMPLE_RATE}::DOUBLE')}
)"""


@register("theta_fanout", sql.query(sql.REC_EVENTS, SCANNED, select="SELECT rule_id, record_id FROM scanned"))
def theta_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = v.rec_events(spark, sf_dir)
    return scan_fanout(records, v.scan_rules(spark, sf_dir), sampling_rule).select("rule_id", "record_id")


def leading_zero(record: Callable[[str], Column]) -> Column:
    return F.substring(F.hex(record("data")), 1, 1) == "0"


def second_half(record: Callable[[str], Column]) -> Column:
    return F.dayofmonth(record("ts")) >= 15


CUSTOM = """
custom AS (
  SELECT 'leading_zero' AS rule_id, record_id FROM rec WHERE data[1] = '0'
  UNION ALL SELECT 'second_half', record_id FROM rec WHERE day(ts) >= 15
)"""
PREDICATES = {"leading_zero": leading_zero, "second_half": second_half}


@register(
    "match_records",
    sql.query(
        *EVENT_MATCHES,
        SCANNED,
        CUSTOM,
        select="SELECT rule_id, record_id FROM matches UNION ALL SELECT * FROM scanned UNION ALL SELECT * FROM custom",
    ),
)
def all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = v.rec_events(spark, sf_dir)
    return match_records(
        v.prepared(records, keep_data=True), v.subscriptions(spark, sf_dir), (v.scan_rules(spark, sf_dir), sampling_rule), PREDICATES
    ).select("rule_id", "record_id")


@register("stream_match", sql.query(*EVENT_MATCHES, select="SELECT rule_id, record_id, first_long FROM matches"))
def streamed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(stream_matches(spark, sf_dir), "stream-match").select("rule_id", "record_id", "first_long")


@register(
    "stream_match_all",
    sql.query(
        *EVENT_MATCHES,
        SCANNED,
        CUSTOM,
        select="SELECT rule_id, record_id FROM matches UNION ALL SELECT * FROM scanned UNION ALL SELECT * FROM custom",
    ),
)
def streamed_matches_of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = v.prepared(v.event_records(event_stream(spark, sf_dir)), keep_data=True)
    scanned = (v.scan_rules(spark, sf_dir), sampling_rule)
    found = stream_match(records, v.subscriptions(spark, sf_dir), scanned, PREDICATES)
    return drain(found.select("rule_id", "record_id"), "stream-match-all")


@register("custom_rule_fanout", sql.query(sql.REC_EVENTS, CUSTOM, select="SELECT rule_id, record_id FROM custom"))
def custom_rule_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicate_fanout(v.rec_events(spark, sf_dir), PREDICATES).select("rule_id", "record_id")
