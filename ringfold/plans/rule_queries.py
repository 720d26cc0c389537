"""Registered queries: rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.operators.rules import (
    frequency_rules,
    place_rules,
    removal_report,
    remove_rules,
    rule_slots,
    RuleSet,
    upsert_rules,
)
from ringfold.plans import sql
from ringfold.plans import views as v
from ringfold.plans.shared import register

RULE_ROWS = 'SELECT rule_id, rule_no, selectivity, "offset", width FROM '


@register("zipf_rules", sql.query(sql.subscriptions(), select=RULE_ROWS + "rules"))
def zipf_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.subscriptions(spark, sf_dir)


SPEC = "(SELECT 1.0::DOUBLE / (l_quantity * 1000) AS selectivity, count(*) AS n FROM lineitem GROUP BY l_quantity)"


@register(
    "frequency_rules",
    sql.query(
        f"spec AS {SPEC}",
        "each AS (SELECT selectivity, unnest(range(n)) AS i FROM spec)",
        "numbers AS (SELECT row_number() OVER (ORDER BY selectivity DESC, i) - 1 AS rule_no, selectivity FROM each)",
        sql.rules_from("numbers"),
        select=RULE_ROWS + "rules",
    ),
)
def frequency_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = (
        v.table(spark, sf_dir, "lineitem")
        .groupBy((F.lit(1.0) / (F.col("l_quantity") * 1000)).alias("selectivity"))
        .agg(F.count("*").alias("n"))
    )
    return frequency_rules(spark, spec, v.SEED, v.HASH)


CHANGES = """(
  SELECT c_custkey AS rule_no, 0.5::DOUBLE AS selectivity FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 1000000000 + s_suppkey, 0.25::DOUBLE FROM supplier
)"""


@register(
    "upsert_rules",
    sql.query(
        sql.subscriptions(),
        sql.rules_from(CHANGES).replace("rules AS", "changes AS"),
        select=f"{RULE_ROWS} rules WHERE rule_id NOT IN (SELECT rule_id FROM changes) UNION ALL {RULE_ROWS} changes",
    ),
)
def upserted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = v.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(
        F.col("c_custkey").alias("rule_no"), F.lit(0.5).alias("selectivity")
    )
    added = v.table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1_000_000_000).alias("rule_no"), F.lit(0.25).alias("selectivity")
    )
    return upsert_rules(v.subscriptions(spark, sf_dir), place_rules(changed.unionAll(added), v.SEED, v.HASH))


@register(
    "upsert_across_kinds",
    sql.query(
        sql.subscriptions(),
        """
changes AS (
  SELECT 'consumer_' || c_custkey AS rule_id, arg_max(o_orderkey, (o_totalprice, o_orderkey))::BIGINT AS seed
  FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 0 GROUP BY ALL
)""",
        select="""
SELECT 'ring' AS kind, rule_id, rule_no AS value FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM changes)
UNION ALL SELECT 'scanned', 'sample_' || n_nationkey, n_nationkey::BIGINT FROM nation
UNION ALL SELECT 'scanned', rule_id, seed FROM changes""",
    ),
)
def rules_across_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring rules of some customers become scanned rules, seeded by their largest order."""
    scanned = v.scan_rules(spark, sf_dir)
    customers = v.table(spark, sf_dir, "customer").where("c_acctbal < 0")
    changes = customers.join(v.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.concat(F.lit("consumer_"), F.col("c_custkey")).alias("rule_id"),
        F.col("o_orderkey").cast("bigint").alias("seed"),
        F.lit(v.SAMPLE_RATE).alias("rate"),
        F.struct("o_totalprice", "o_orderkey").alias("at"),
    )
    rules = RuleSet(v.subscriptions(spark, sf_dir), scanned).upsert("scanned", changes, "at")
    ring = rules.ring.select(F.lit("ring").alias("kind"), "rule_id", F.col("rule_no").cast("bigint").alias("value"))
    return ring.unionByName(rules.scanned.select(F.lit("scanned").alias("kind"), "rule_id", F.col("seed").alias("value")))


REMOVED = """
removed AS (
  SELECT 'consumer_' || c_custkey AS rule_id FROM customer WHERE c_nationkey < 7
  UNION ALL SELECT 'consumer_' || (1000000000 + s_suppkey) FROM supplier
)"""


def _removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = v.table(spark, sf_dir, "customer").where("c_nationkey < 7").select(F.col("c_custkey").alias("rule_no"))
    unknown = v.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("rule_no"))
    return known.unionAll(unknown).select(F.concat(F.lit("consumer_"), F.col("rule_no")).alias("rule_id"))


@register(
    "remove_rules",
    sql.query(
        sql.subscriptions(), REMOVED, select=RULE_ROWS + "rules WHERE rule_id NOT IN (SELECT rule_id FROM removed)"
    ),
)
def remaining_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_rules(v.subscriptions(spark, sf_dir), _removed(spark, sf_dir))


@register(
    "removal_report",
    sql.query(
        sql.subscriptions(),
        REMOVED,
        select="SELECT DISTINCT rule_id, rule_id IN (SELECT rule_id FROM rules) AS found FROM removed",
    ),
)
def removed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(v.subscriptions(spark, sf_dir), _removed(spark, sf_dir))


SLOT_BITS = 16


@register(
    "rule_slots",
    sql.query(
        sql.subscriptions(),
        f"slots AS (SELECT unnest(range({1 << SLOT_BITS})) AS slot)",
        f'bounds AS (SELECT slot, slot * {1 << 63 - SLOT_BITS}::BIGINT AS low FROM slots)',
        # an arc touches a slot that it starts in, or whose first position it holds
        select=f"""
SELECT slot, rule_id FROM rules, bounds
WHERE width < 0 OR (width > 0 AND (("offset" >> {63 - SLOT_BITS}) = slot OR {sql.in_arc('low', '"offset"', 'width')}))""",
    ),
)
def slotted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_slots(v.subscriptions(spark, sf_dir), SLOT_BITS).select("slot", "rule_id")
