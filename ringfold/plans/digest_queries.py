"""Registered queries: shuffle and folds, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.functions.payload import leading_long, wrapping_sum
from ringfold.operators.digest import partition_by_rule, running_count_events
from ringfold.operators.fanout import matches_per_rule, rule_hit_rate
from ringfold.operators.rules import zipf_rules
from ringfold.plans import sql
from ringfold.plans import views as v
from ringfold.plans.shared import (
    EVENT_MATCHES,
    EVERY,
    PAYLOAD_STATE,
    digest_fields,
    digests,
    event_matches,
    register,
    sized,
)

SPARSE_EVERY = 3


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events over 50 Zipf rules, digests of every 10 matches of a rule."""
    rules = zipf_rules(spark, 50, 5.0, 1.0, v.SEED, v.HASH, v.DIGITS)
    return digest_fields(digests(v.rec_events(spark, sf_dir), rules))


register(
    "fanout_digest",
    sql.query(
        sql.REC_EVENTS,
        sql.PREPARED,
        sql.zipf(5.0, 1.0, "(SELECT unnest(range(50)) AS rule_no)"),
        sql.rules_from("selectivities"),
        sql.MATCHES,
        sql.numbered(EVERY),
        sql.digest(EVERY),
        select=sql.DIGEST_ROWS,
    ),
)(flagship)


@register(
    "matches_per_rule", sql.query(*EVENT_MATCHES, select="SELECT rule_id, count(*) AS n_matches FROM matches GROUP BY rule_id")
)
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches_per_rule(event_matches(spark, sf_dir))


@register(
    "partition_by_rule",
    sql.query(*EVENT_MATCHES, select="SELECT rule_id, 1::BIGINT AS n_partitions FROM matches GROUP BY rule_id"),
)
def rule_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = partition_by_rule(sized(event_matches(spark, sf_dir), spark, sf_dir))
    part = F.col("part") if "part" in placed.columns else F.lit(0)
    places = placed.groupBy("rule_id", part.alias("part"), F.spark_partition_id().alias("place")).count()
    per_part = places.groupBy("rule_id", "part").agg(F.count("*").alias("n"))
    return per_part.groupBy("rule_id").agg(F.max("n").alias("n_partitions"))


@register(
    "running_count_events",
    sql.query(
        *EVENT_MATCHES,
        sql.numbered(EVERY),
        select=f"""
SELECT rule_id, idx + 1 AS n, record_id, upper({sql.hex_long('idx + 1')}) AS value
FROM placed WHERE (idx + 1) % {EVERY} = 0""",
    ),
)
def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = running_count_events(sized(event_matches(spark, sf_dir), spark, sf_dir), EVERY)
    return events.select("rule_id", "n", "record_id", F.hex("value").alias("value"))


@register(
    "count_window_digest", sql.query(*EVENT_MATCHES, sql.numbered(EVERY), sql.digest(EVERY), select=sql.DIGEST_ROWS)
)
def window_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_fields(digests(v.rec_events(spark, sf_dir), v.subscriptions(spark, sf_dir)))


PHASE = sql.signed(sql.hash16("encode('8902763414119392010:') || unhex(substr(data, 1, 64))"))


def _phase(every: int) -> str:
    first = f"first_value({PHASE}) OVER (PARTITION BY rule_id ORDER BY ts, record_id)"
    return f"((({first}) % {every} + {every}) % {every})"


@register(
    "count_window_digest_phased",
    sql.query(*EVENT_MATCHES, sql.numbered(EVERY, _phase(EVERY)), sql.digest(EVERY), select=sql.DIGEST_ROWS),
)
def phased_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = v.subscriptions(spark, sf_dir)
    return digest_fields(digests(v.rec_events(spark, sf_dir), rules, random_phase=True))


@register(
    "wrapping_sum",
    sql.query(
        sql.REC_EVENTS,
        sql.PREPARED,
        select=f"""
SELECT user_id, {sql.wrap('sum(first_long::HUGEINT)')} AS total
FROM prepared JOIN events ON record_id = event_id GROUP BY user_id""",
    ),
)
def wrapping_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.unhex(F.md5(F.col("event_id").cast("string").cast("binary")))
    return v.table(spark, sf_dir, "events").groupBy("user_id").agg(wrapping_sum(leading_long(data)).alias("total"))


ROOM = 2 * (PAYLOAD_STATE - 32)


@register(
    "payload_overlay",
    sql.query(
        sql.PADDED_DOCS,
        sql.PREPARED,
        sql.subscriptions(),
        sql.MATCHES,
        sql.numbered(SPARSE_EVERY),
        f"""
layers AS (
  SELECT rule_id, cycle, list(substr(data, 1, {ROOM}) ORDER BY pos) AS digits
  FROM placed GROUP BY rule_id, cycle HAVING count(*) = {SPARSE_EVERY}
)""",
        select=f"""
SELECT rule_id, cycle::BIGINT AS cycle,
       list_reduce(list_prepend(repeat('0', {ROOM}), digits),
                   lambda under, top: top || substr(under, length(top) + 1)) AS payload
FROM layers""",
    ),
)
def payload_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digests(
        v.padded_docs(spark, sf_dir), v.subscriptions(spark, sf_dir), SPARSE_EVERY, PAYLOAD_STATE
    )
    return found.select("rule_id", "cycle", F.hex("payload").alias("payload"))


@register(
    "rule_hit_rate",
    sql.query(
        *EVENT_MATCHES,
        "hits AS (SELECT rule_id, count(*) AS n_matches FROM matches GROUP BY rule_id)",
        """
rates AS (
  SELECT rule_id, least(selectivity, 1) AS p, coalesce(n_matches, 0) AS n_matches, (SELECT count(*) FROM rec) AS n
  FROM rules LEFT JOIN hits USING (rule_id)
)""",
        select="""
SELECT rule_id, n_matches, round(n_matches / n, 9) AS rate,
       round(CASE WHEN p > 0 AND p < 1 THEN (n_matches - n * p) / sqrt(n * p * (1 - p)) END, 6) AS z
FROM rates""",
    ),
)
def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = v.subscriptions(spark, sf_dir)
    rates = rule_hit_rate(event_matches(spark, sf_dir), v.table(spark, sf_dir, "events"), rules)
    return rates.select("rule_id", "n_matches", F.round("rate", 9).alias("rate"), F.round("z", 6).alias("z"))
