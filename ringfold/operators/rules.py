"""Rule tables: one row per subscription, an arc on the hash ring each.

Columns: ``rule_id, rule_no, selectivity, offset, width``. A rule table is data like
any other: it is built, changed and indexed with joins and projections.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ringfold.functions.ring import RING_MASK, arc_width, rule_offset
from ringfold.workdir import stored

# Fixed value: the default seed of rule offsets.
RULE_SEED = 0x2E3FAC4F58FC98B4
RULE_COLUMNS = ["rule_id", "rule_no", "selectivity", "offset", "width"]
RING_BITS = 63
LEVEL_STEP = 4
COUNT_CHUNK = 1 << 16
RULES_PER_TASK = 1 << 22
SMALL_SPEC = 100_000


def place_rules(rules: DataFrame, seed: int | str = RULE_SEED, hash: str = "xxhash64") -> DataFrame:
    """Turn ``(rule_no, selectivity)`` into a rule table."""
    return rules.select(
        F.concat(F.lit("consumer_"), F.col("rule_no").cast("string")).alias("rule_id"),
        F.col("rule_no").cast("bigint").alias("rule_no"),
        F.col("selectivity"),
        rule_offset(seed, F.col("rule_no"), hash).alias("offset"),
        arc_width(F.col("selectivity")).alias("width"),
    )


def zipf_selectivities(
    numbers: DataFrame, total_selectivity: float = 0.2, s: float = 0.0, digits: int | None = None
) -> DataFrame:
    """Selectivity of each ``rule_no``: its share 1/(rule_no+1)^s of the total.

    The weights are summed as decimals, so the total does not depend on the order in
    which partitions arrive. ``digits`` rounds the result.
    """
    weighted = numbers.select("rule_no", (F.lit(1.0) / F.pow(F.col("rule_no") + 1, F.lit(float(s)))).alias("weight"))
    total = weighted.agg(F.sum(F.col("weight").cast("decimal(28,18)")).cast("double")).scalar()
    share = F.col("weight") / total * F.lit(float(total_selectivity))
    return weighted.select("rule_no", (share if digits is None else F.round(share, digits)).alias("selectivity"))


def zipf_rules(
    spark: SparkSession,
    num_rules: int = 1000,
    total_selectivity: float = 0.2,
    s: float = 0.0,
    seed: int | str = RULE_SEED,
    hash: str = "xxhash64",
    digits: int | None = None,
) -> DataFrame:
    """Rules whose selectivities follow Zipf's law with exponent ``s`` (0 is uniform)."""
    numbers = spark.range(num_rules).withColumnRenamed("id", "rule_no")
    return place_rules(zipf_selectivities(numbers, total_selectivity, s, digits), seed, hash)


def frequency_numbers(spec: DataFrame) -> DataFrame:
    """``(selectivity, n)`` to n rows ``(rule_no, selectivity)`` each.

    Rules are numbered from 0, highest selectivity first.
    """
    spec = spec.groupBy("selectivity").agg(F.sum("n").cast("bigint").alias("n")).where(F.col("n") > 0)
    size = spec.agg(F.count("*").alias("entries"), F.coalesce(F.sum("n"), F.lit(0)).alias("rules")).first()
    chunks = _running_start(spec, size["entries"]).select(
        "selectivity",
        "n",
        "first",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COUNT_CHUNK).cast("bigint"))).alias("lo"),
    )
    # a chunk is one small row until it is unfolded, so tasks are set by rules, not bytes
    tasks = -(-size["rules"] // RULES_PER_TASK)
    if tasks > 1:
        chunks = chunks.repartition(tasks, "first", "lo")
    last = F.least(F.col("lo") + (COUNT_CHUNK - 1), F.col("n") - 1)
    numbers = F.sequence(F.col("first") + F.col("lo"), F.col("first") + last)
    return chunks.select(F.explode(numbers).alias("rule_no"), "selectivity")


def _running_start(spec: DataFrame, entries: int) -> DataFrame:
    """Add ``first``: the number of rules before this entry, highest selectivity first."""
    order = F.desc("selectivity")
    before = (W.unboundedPreceding, -1)
    if entries <= SMALL_SPEC:
        total = F.sum("n").over(W.orderBy(order).rowsBetween(*before))
        return spec.select("*", F.coalesce(total, F.lit(0)).cast("bigint").alias("first"))
    # Too many entries for one task: number inside range partitions, then add what the
    # partitions before hold. Stored, so that partition numbers cannot change.
    parts = stored(spec.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "spec")
    sums = parts.groupBy("part").agg(F.sum("n").alias("part_n"))
    base = sums.select("part", F.sum("part_n").over(W.orderBy("part").rowsBetween(*before)).alias("base"))
    inside = F.sum("n").over(W.partitionBy("part").orderBy(order).rowsBetween(*before))
    return (
        parts.join(base, "part")
        .select("selectivity", "n", (F.coalesce("base", F.lit(0)) + F.coalesce(inside, F.lit(0))).alias("first"))
        .withColumn("first", F.col("first").cast("bigint"))
    )


def frequency_rules(
    spark: SparkSession,
    selectivities: Mapping[float, int] | DataFrame,
    seed: int | str = RULE_SEED,
    hash: str = "xxhash64",
) -> DataFrame:
    """Rules from a map or table of how many rules have which selectivity."""
    if not isinstance(selectivities, DataFrame):
        rows = [(float(p), int(n)) for p, n in selectivities.items()]
        selectivities = spark.createDataFrame(rows, "selectivity double, n bigint")
    return place_rules(frequency_numbers(selectivities), seed, hash)


def upsert_rules(rules: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Add rules; one whose id exists is replaced.

    Of several changes of one id the last by column ``order`` counts. Without ``order``
    an id that occurs twice is an error.
    """
    changes = last_changes(changes, order).select(*rules.columns)
    return rules.join(changes, "rule_id", "left_anti").select(*rules.columns).unionByName(changes)


def last_changes(changes: DataFrame, order: str | None = None) -> DataFrame:
    """One change per rule id, the last by ``order``."""
    if order is None:
        twice = changes.groupBy("rule_id").agg(F.count("*").alias("n")).where("n > 1").head(1)
        if twice:
            raise ValueError(f"rule {twice[0]['rule_id']!r} is changed twice; name a column that orders the changes")
        return changes
    last = changes.groupBy("rule_id").agg(F.max_by(F.struct(*changes.columns), order).alias("last"))
    return last.select("last.*")


class RuleSet(NamedTuple):
    """Rules of all kinds. An id is in one kind only."""

    ring: DataFrame
    scanned: DataFrame
    predicates: Mapping[str, Callable] = {}

    def upsert(self, kind: str, changes: DataFrame | Mapping[str, Callable], order: str | None = None) -> RuleSet:
        """Add rules of one kind; the same ids leave the other kinds."""
        if kind not in self._fields:
            raise ValueError(f"kind must be one of {self._fields}, not {kind!r}")
        if kind == "predicates":
            ids = self.ring.sparkSession.createDataFrame([(i,) for i in changes], "rule_id string")
            return RuleSet(remove_rules(self.ring, ids), remove_rules(self.scanned, ids), {**self.predicates, **changes})
        ids = last_changes(changes, order).select("rule_id")
        rest = self.remove(ids)
        old = getattr(self, kind)
        return rest._replace(**{kind: upsert_rules(old, changes, order)})

    def remove(self, ids: DataFrame) -> RuleSet:
        """Drop the listed rules, of whatever kind they are."""
        known = ids.where(F.col("rule_id").isin(list(self.predicates))).distinct().collect() if self.predicates else []
        gone = {r["rule_id"] for r in known}
        kept = {i: p for i, p in self.predicates.items() if i not in gone}
        return RuleSet(remove_rules(self.ring, ids), remove_rules(self.scanned, ids), kept)


def remove_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop the rules listed in ``ids``."""
    return rules.join(ids, "rule_id", "left_anti")


def removal_report(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """For each listed id, whether there was such a rule to remove."""
    known = rules.select("rule_id").withColumn("found", F.lit(True))
    return (
        ids.select("rule_id")
        .distinct()
        .join(known, "rule_id", "left")
        .select("rule_id", F.coalesce("found", F.lit(False)).alias("found"))
    )


def rule_slots(rules: DataFrame, bits: int = 16) -> DataFrame:
    """List each rule under every one of 2^bits equal slots its arc touches.

    The count of touched slots is exact, a match-all rule is in all of them, an empty
    arc in none. Shifts and masks keep it inside 64 bits.
    """
    if not 1 <= bits <= 30:
        raise ValueError(f"bits must be between 1 and 30, not {bits}")
    slots = 1 << bits
    shift = RING_BITS - bits
    low = F.lit((1 << shift) - 1)
    offset, width = F.col("offset"), F.col("width")
    spill = F.shiftright(offset.bitwiseAND(low) + width.bitwiseAND(low) - 1, shift)
    touched = (
        F.when(width < 0, F.lit(slots).cast("bigint"))
        .when(width == 0, F.lit(0).cast("bigint"))
        .otherwise(F.least(F.shiftright(width, shift) + spill + 1, F.lit(slots).cast("bigint")))
    )
    # in chunks, as a wide arc touches up to 2^30 slots
    chunk = F.lit(COUNT_CHUNK).cast("bigint")
    chunks = F.sequence(F.lit(0).cast("bigint"), F.col("touched") - 1, chunk)
    steps = F.sequence("lo", F.least(F.col("lo") + chunk, "touched") - 1)
    return (
        rules.select("*", touched.alias("touched"))
        .where(F.col("touched") > 0)
        .select(*rules.columns, "touched", F.explode(chunks).alias("lo"))
        .select(*rules.columns, F.explode(steps).alias("step"))
        .select(((F.shiftright(offset, shift) + F.col("step")) % slots).alias("slot"), *rules.columns)
    )


def node_of(position: Column, level: Column | int) -> Column:
    """Number of the ring segment that holds a position, at one level.

    Level L cuts the ring into 2^L segments. Adding 2^L to the segment's index makes
    the number unique over all levels, so one integer is the join key.
    """
    if isinstance(level, int):
        return F.lit(1 << level) + F.shiftright(position, RING_BITS - level)
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level) + F.call_function(
        "shiftright", position, F.lit(RING_BITS) - level
    )


def rule_levels() -> Column:
    """Finest level, in steps, whose segments are at least as wide as the rule's arc."""
    level = F.lit(0)
    for candidate in range(LEVEL_STEP, RING_BITS - 1, LEVEL_STEP):
        level = F.when(F.col("width") <= F.lit(1 << (RING_BITS - candidate)), F.lit(candidate)).otherwise(level)
    return F.when(F.col("width") < 0, F.lit(0)).otherwise(level)


def rule_nodes(rules: DataFrame) -> DataFrame:
    """Index rows ``(node, level, rule_id, offset, width)``, at most two per rule.

    A segment is never narrower than the arc, so an arc touches one segment or two
    neighbours however wide it is. Empty arcs match nothing and are left out.
    """
    level = F.col("level")
    reach = F.greatest("width", F.lit(1)) - 1
    room = F.lit(RING_MASK) - F.col("offset")
    last = F.when(reach <= room, F.col("offset") + reach).otherwise(reach - room - 1)
    ends = F.array_distinct(F.array(node_of(F.col("offset"), level), node_of(last, level)))
    nodes = F.when(level == 0, F.array(F.lit(1).cast("bigint"))).otherwise(ends)
    return (
        rules.where(F.col("width") != 0)
        .select("rule_id", "offset", "width", rule_levels().cast("int").alias("level"))
        .select(F.explode(nodes).alias("node"), "level", "rule_id", "offset", "width")
    )
