"""Registered queries: projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.functions.payload import event_pack, event_unpack, leading_long
from ringfold.functions.ring import RING_MASK, arc_width, hash_sample, in_arc, ring_position
from ringfold.functions.timing import epoch_ms
from ringfold.operators import metrics
from ringfold.operators.fanout import ring_range_join
from ringfold.operators.rules import place_rules
from ringfold.plans import sql
from ringfold.plans import views as v
from ringfold.plans.shared import PAYLOAD_STATE, register

@register("timestamp_attach", sql.query(sql.REC_EVENTS, select=f"SELECT record_id, {sql.MS} AS ts_ms, data FROM rec"))
def timestamp_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.rec_events(spark, sf_dir).select(
        "record_id", epoch_ms(F.col("ts")).alias("ts_ms"), F.hex("data").alias("data")
    )


@register("ring_position", sql.query(sql.REC_DOCS, select=f"SELECT record_id, {sql.position('data')} AS position FROM rec"))
def ring_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.rec_docs(spark, sf_dir).select("record_id", ring_position(F.col("data"), v.HASH).alias("position"))


@register(
    "hash_sample",
    sql.query(
        sql.REC_EVENTS,
        select=f"""SELECT record_id FROM rec WHERE {sql.sampled('data', "'1234'", '0.3::DOUBLE')}""",
    ),
)
def hash_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.rec_events(spark, sf_dir).where(hash_sample(F.col("data"), 1234, 0.3, v.HASH)).select("record_id")


ARC_START = RING_MASK - (1 << 61)


@register(
    "ring_range_filter",
    sql.query(
        sql.REC_EVENTS,
        sql.PREPARED,
        select="SELECT record_id FROM prepared WHERE "
        + sql.in_arc("position", f"{ARC_START}::BIGINT", sql.width("0.3::DOUBLE")),
    ),
)
def ring_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = ring_position(F.col("data"), v.HASH)
    inside = in_arc(position, F.lit(ARC_START), arc_width(F.lit(0.3)))
    return v.rec_events(spark, sf_dir).where(inside).select("record_id")


def _edge_selectivity(key: str, double: str) -> str:
    # none, almost none, some, almost all, all, more than all
    cases = {0: "0", 1: "pow(2, -40)", 2: "0.3", 3: "(1 - pow(2, -20))", 4: "1", 5: "2"}
    return f"CASE {key} % 6 " + " ".join(f"WHEN {k} THEN CAST({x} AS {double})" for k, x in cases.items()) + " END"


@register(
    "ring_match_all",
    sql.query(
        sql.REC_EVENTS,
        sql.PREPARED,
        sql.rules_from(f"(SELECT n_nationkey AS rule_no, {_edge_selectivity('n_nationkey', 'DOUBLE')} AS selectivity FROM nation)"),
        sql.MATCHES,
        select="SELECT rule_id, count(*) AS n_matches, min(record_id) AS first_id, max(record_id) AS last_id "
        "FROM matches GROUP BY rule_id",
    ),
)
def ring_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = v.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("rule_no"), F.expr(_edge_selectivity("n_nationkey", "DOUBLE")).alias("selectivity")
    )
    matches = ring_range_join(v.prepared(v.rec_events(spark, sf_dir)), place_rules(numbers, v.SEED, v.HASH))
    return matches.groupBy("rule_id").agg(
        F.count("*").alias("n_matches"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id")
    )


@register(
    "decode_first_long",
    sql.query(sql.PADDED_DOCS, select=f"SELECT record_id, {sql.signed('substr(data, 1, 16)')} AS first_long FROM rec"),
)
def decode_first_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.padded_docs(spark, sf_dir).select("record_id", leading_long(F.col("data")).alias("first_long"))


def _doc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = epoch_ms(F.col("ts"))
    value = event_pack(
        F.lit(1), leading_long(F.col("data")), ms - 1000, ms, F.substring("data", 1, 32), PAYLOAD_STATE
    )
    return v.padded_docs(spark, sf_dir).select("record_id", value.alias("value"))


@register(
    "event_pack",
    sql.query(
        sql.PADDED_DOCS,
        select=f"""
SELECT record_id,
       '0000000000000001' || substr(data, 1, 16) || upper({sql.hex_long(sql.MS + ' - 1000')})
         || upper({sql.hex_long(sql.MS)}) || rpad(substr(data, 1, 64), 64, '0') AS value
FROM rec""",
    ),
)
def packed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_events(spark, sf_dir).select("record_id", F.hex("value").alias("value"))


@register(
    "event_unpack",
    sql.query(
        sql.PADDED_DOCS,
        select=f"""
SELECT record_id, 1::BIGINT AS n, {sql.signed('substr(data, 1, 16)')} AS total, {sql.MS} - 1000 AS start_ms,
       {sql.MS} AS end_ms, rpad(substr(data, 1, 64), 64, '0') AS payload
FROM rec""",
    ),
)
def unpacked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = event_unpack(F.col("value"))
    fields["payload"] = F.hex(fields["payload"])
    return _doc_events(spark, sf_dir).select("record_id", *[c.alias(name) for name, c in fields.items()])


@register("latency_split", sql.query(sql.DELIVERIES, select="SELECT event_id, sign, latency FROM samples"))
def latency_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latencies(v.deliveries(spark, sf_dir)).select("event_id", "sign", "latency")
