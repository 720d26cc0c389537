"""Registered queries: folds on streams, and folds of one's own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.functions.payload import event_unpack
from ringfold.operators import dense
from ringfold.operators.digest import MAX_ROWS, split_hot_rules
from ringfold.operators.folds import Fold, Merge, batch_fold, merge_fold, window_fold
from ringfold.operators.rules import place_rules, remove_rules, upsert_rules
from ringfold.plans import sql
from ringfold.plans import views as v
from ringfold.plans.shared import (
    EVENT_MATCHES,
    EVERY,
    digest_fields,
    drain,
    event_matches,
    event_slices,
    event_stream,
    publish,
    register,
    sized,
    stream_matches,
)
from ringfold.streaming.changes import ChangingRules, RuleVersions
from ringfold.streaming.counts import start_count_stream
from ringfold.streaming.digest import DigestSink, start_digest_stream
from ringfold.streaming.job import start_job
from ringfold.streaming.state import stateful_digest
from ringfold.workdir import stored, work_dir

STREAMED_DIGEST = sql.query(
    *EVENT_MATCHES, sql.numbered(EVERY), sql.digest(EVERY), select=sql.DIGEST_ROWS
)


@register("stream_digest", STREAMED_DIGEST)
def stream_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "stream-digest")
    query = start_digest_stream(stream_matches(spark, sf_dir), path, f"{path}/checkpoint", EVERY)
    query.awaitTermination()
    return digest_fields(spark.read.parquet(f"{path}/events"))


@register("stateful_digest", STREAMED_DIGEST)
def stateful_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the stream's micro-batches are of a few files, so they may be folded in order
    found = stateful_digest(stream_matches(spark, sf_dir), EVERY, mode="append", in_order=True)
    return digest_fields(drain(found, "stateful-digest"))


@register(
    "stream_job",
    sql.query(
        *EVENT_MATCHES,
        sql.numbered(EVERY),
        sql.digest(EVERY),
        select="SELECT rule_id AS key, n, total, start_ms, end_ms FROM digests",
    ),
)
def stream_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "stream-job")
    records = v.event_records(event_stream(spark, sf_dir))
    start_job(records, v.subscriptions(spark, sf_dir), path, EVERY, hash=v.HASH).awaitTermination()
    fields = event_unpack(F.col("value"))
    kept = [fields[name].alias(name) for name in ("n", "total", "start_ms", "end_ms")]
    return spark.read.parquet(f"{path}/events").select("key", *kept)


@register(
    "stream_restart",
    sql.query(
        *EVENT_MATCHES,
        sql.numbered(EVERY),
        sql.digest(EVERY),
        select="SELECT rule_id, n, total, start_ms, end_ms FROM digests",
    ),
)
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job on the state store that stops after half of the input and goes on elsewhere.

    The second run has another number of shuffle partitions, as another cluster would.
    """
    path = work_dir(spark, "stream-restart")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    files, width = event_slices(spark, sf_dir)
    # the first run takes whole micro-batches
    source, half = work_dir(spark, "event-stream"), len(files) // (2 * width) * width
    try:
        for arrived, partitions in ((files[:half], 4), (files[half:], 6)):
            publish(spark, arrived, source)
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            records = v.event_records(event_stream(spark, sf_dir, source, width))
            options = {"engine": "state_store", "in_order": True, "max_per_trigger": width, "hash": v.HASH}
            start_job(records, v.subscriptions(spark, sf_dir), path, EVERY, **options).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    events = spark.read.parquet(f"{path}/events")
    fields = event_unpack(F.col("value"))
    kept = [fields[name].alias(name) for name in ("n", "total", "start_ms", "end_ms")]
    return events.select(F.col("key").alias("rule_id"), *kept)


RUNNING_COUNTS = sql.query(
    *EVENT_MATCHES,
    sql.numbered(EVERY),
    select=f"""
SELECT rule_id, idx + 1 AS n, record_id, upper({sql.hex_long('idx + 1')}) AS value
FROM placed WHERE (idx + 1) % {EVERY} = 0""",
)


@register("stream_running_count", RUNNING_COUNTS)
def stream_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "stream-count")
    start_count_stream(stream_matches(spark, sf_dir), path, f"{path}/checkpoint", EVERY).awaitTermination()
    return spark.read.parquet(f"{path}/events").select("rule_id", "n", "record_id", F.hex("value").alias("value"))


CHANGED = "(SELECT c_custkey AS rule_no, 0.002::DOUBLE AS selectivity FROM customer WHERE c_acctbal < 0)"
EARLIER = "coalesce(epoch_us(p.ts) < (SELECT middle_us FROM border), true)"


def _part(rules: str, where: str) -> str:
    arc = sql.in_arc("p.position", 'r."offset"', "r.width")
    return f"SELECT r.rule_id, p.* FROM prepared p JOIN {rules} r ON {arc} WHERE {where}"


@register(
    "stream_rule_changes",
    sql.query(
        sql.REC_EVENTS,
        sql.PREPARED,
        sql.subscriptions(),
        sql.rules_from(CHANGED).replace("rules AS", "changes AS"),
        f"""
later AS (
  SELECT * FROM changes
  UNION ALL SELECT * FROM rules WHERE rule_id NOT IN (
    SELECT 'consumer_' || c_custkey FROM customer WHERE c_acctbal < 0 OR c_nationkey < 7)
),
border AS (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 AS middle_us FROM rec),
matches AS ({_part("rules", EARLIER)} UNION ALL {_part("later", f"NOT {EARLIER}")})""",
        sql.numbered(EVERY),
        sql.digest(EVERY),
        select=sql.DIGEST_ROWS,
    ),
)
def stream_rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose rules are removed, changed and put back once half of its time is over."""
    path, source = work_dir(spark, "stream-changes"), work_dir(spark, "event-stream")
    versions = RuleVersions(spark, f"{path}/rules")
    sink = DigestSink(f"{path}/digests", EVERY)
    changing = ChangingRules(versions.path, path, sink, dense=dense.DENSE_SHARE)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = v.table(spark, sf_dir, "events").agg(F.min(at), F.max(at)).first()
    earlier = F.coalesce(at < F.lit(None if low is None else low + (high - low) // 2), F.lit(True))
    for rules, where in ((_rules(spark, sf_dir), earlier), (_later_rules(spark, sf_dir), ~earlier)):
        versions.publish(rules)
        files, width = event_slices(spark, sf_dir, where, slices=3)
        publish(spark, files, source)
        records = v.prepared(v.event_records(event_stream(spark, sf_dir, source, width)))
        run = records.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(changing)
        run.trigger(availableNow=True).start().awaitTermination()
    return digest_fields(spark.read.parquet(sink.events))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.subscriptions(spark, sf_dir)


def _later_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = v.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "rule_no")
    gone = customers.where("c_nationkey < 7").select(F.concat(F.lit("consumer_"), "rule_no").alias("rule_id"))
    changed = customers.where("c_acctbal < 0").select("rule_no", F.lit(0.002).alias("selectivity"))
    return upsert_rules(remove_rules(_rules(spark, sf_dir), gone), place_rules(changed, v.SEED, v.HASH))


def record_highs() -> Fold:
    """A consumer of one's own: an event whenever a rule sees a new highest value.

    Made by a function, so that it travels to the tasks whole and they need no import.
    """

    def fold(key: str, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        values = rows["first_long"].to_numpy()
        start = np.iinfo(np.int64).min if state is None else state[0]
        before = np.maximum.accumulate(np.concatenate([[start], values]))
        new = values > before[:-1]
        new[0] |= state is None
        out = [(key, int(r), int(x)) for r, x in zip(rows["record_id"].to_numpy()[new], values[new])]
        return (int(before[-1]),), out

    return fold


@register(
    "custom_digest",
    sql.query(
        *EVENT_MATCHES,
        """
ranked AS (
  SELECT rule_id, record_id, first_long,
         max(first_long) OVER (PARTITION BY rule_id ORDER BY ts, record_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM matches
)""",
        select="SELECT rule_id, record_id, first_long AS high FROM ranked WHERE before IS NULL OR first_long > before",
    ),
)
def custom_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = event_matches(spark, sf_dir)
    return batch_fold(matches, record_highs(), "rule_id string, record_id bigint, high bigint")


def window_ranges(every: int) -> Fold:
    """A consumer of one's own per window: lowest and highest value once it is full."""

    def fold(key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        values = rows["first_long"].to_numpy()
        n, low, high = state or (0, 2**63 - 1, -(2**63))
        state = (n + len(rows), min(low, int(values.min())), max(high, int(values.max())))
        return state, [(key[0], int(key[1]), state[1], state[2])] if state[0] == every else []

    return fold


@register(
    "custom_window_digest",
    sql.query(
        *EVENT_MATCHES,
        sql.numbered(EVERY),
        select=f"""
SELECT rule_id, cycle::BIGINT AS cycle, min(first_long) AS low, max(first_long) AS high
FROM placed GROUP BY rule_id, cycle HAVING count(*) = {EVERY}""",
    ),
)
def custom_window_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = sized(event_matches(spark, sf_dir), spark, sf_dir)
    schema = "rule_id string, cycle bigint, low bigint, high bigint"
    return window_fold(matches, EVERY, window_ranges(EVERY), schema, ["first_long"])


PAUSE_US = 3_600_000_000
#: A rule with more than this share of all matches is folded in parts.
HOT_PART = 16


def pauses(longest_us: int) -> tuple[Fold, Merge]:
    """A consumer of one's own: an event for each record that comes more than a while after the one before.

    The state is the first and last time and the number of records, so states of two
    stretches merge; the event carries the record's number within the whole rule.
    """

    def fold(key: str, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        at = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        first, last, n = state or (int(at[0]), int(at[0]), 0)
        gap = np.diff(np.concatenate([[last], at]))
        late = np.flatnonzero(gap > longest_us)
        ids = rows["record_id"].to_numpy()
        out = [(key, int(ids[i]), n + int(i) + 1, int(gap[i])) for i in late]
        return (first, int(at[-1]), n + len(rows)), out

    def merge(earlier: tuple, later: tuple) -> tuple:
        return earlier[0], later[1], earlier[2] + later[2]

    return fold, merge


@register(
    "custom_merge_digest",
    sql.query(
        *EVENT_MATCHES,
        """
followed AS (
  SELECT rule_id, record_id, row_number() OVER w AS n, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS pause_us
  FROM matches WINDOW w AS (PARTITION BY rule_id ORDER BY ts, record_id)
)""",
        select=f"SELECT rule_id, record_id, n, pause_us FROM followed WHERE pause_us > {PAUSE_US}",
    ),
)
def custom_merge_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = stored(event_matches(spark, sf_dir), "merge-matches")
    most = max(1, min(MAX_ROWS, matches.count() // HOT_PART))
    fold, merge = pauses(PAUSE_US)
    found = split_hot_rules(matches, most) or matches
    return merge_fold(found, fold, merge, "rule_id string, record_id bigint, n bigint, pause_us bigint")
