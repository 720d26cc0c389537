"""Count windows of rules that together match a record many times, without a row per match.

Such matches grow with records times rules, and a shuffle by rule would carry each of
them. Here the records go to the rules instead: a rule is listed at the one segment its
arc starts in, a record at its own segment and at the one before, since no arc is wider
than a segment. A group then has all records of its rules, and gives a row per window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.functions.ring import RING_MASK, RING_SIZE
from ringfold.operators.rules import RING_BITS, node_of, rule_levels

#: Matches per record from which the rules of a level are dense.
DENSE_SHARE = 4.0
#: Coarsest level that may be dense: a group holds two segments, here less than 1 % of the records.
DENSE_LEVEL = 8
#: Record-rule pairs of a group, beyond which its rules are dealt over several.
GROUP_PAIRS = 1 << 24
#: Pairs of a task.
TASK_PAIRS = 1 << 22
#: Columns of prepared records that a window needs; records with others take the plain way.
DENSE_COLUMNS = {"record_id", "ts", "position", "first_long"}

WINDOW_FIELDS = (
    "rule_id string, cycle bigint, pos bigint, weight bigint, first_long bigint, start_ms bigint, end_ms bigint, whole boolean"
)


class DenseMatches(NamedTuple):
    """Matches of which only those of some rules, ``rows``, are made.

    Those of ``rules``, which are of the given levels, follow from ``records``. A rule id
    is in one of the two.
    """

    rows: DataFrame
    records: DataFrame
    rules: DataFrame
    levels: Sequence[int]


def dense_levels(rules: DataFrame, share: float = DENSE_SHARE) -> list[int]:
    """Levels of the index whose rules together match a record more than ``share`` times."""
    levels = rules.where(F.col("width") > 0).groupBy(rule_levels().cast("int").alias("level"))
    matched = F.sum(F.col("width") / F.lit(RING_SIZE))
    found = levels.agg(matched.alias("matched")).where((F.col("level") >= DENSE_LEVEL) & (F.col("matched") > share))
    return sorted(r["level"] for r in found.collect())


def dense_rules(rules: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Rules of some levels, each with the segment its arc starts in."""
    placed = rules.where(F.col("width") > 0).withColumn("level", rule_levels().cast("int"))
    node = node_of(F.col("offset"), F.col("level")).alias("node")
    return placed.where(F.col("level").isin(list(levels))).select(node, "rule_id", "offset", "width")


def _listed(records: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Records at their segment and at the one before, per level."""
    nodes = []
    for level in levels:
        own = F.shiftright("position", RING_BITS - level)
        before = (own - 1).bitwiseAND(F.lit((1 << level) - 1))
        nodes += [F.lit(1 << level) + own, F.lit(1 << level) + before]
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    kept = records.where(F.col("position").isNotNull())
    return kept.select(F.explode(F.array(*nodes)).alias("node"), "record_id", at, "position", "first_long")


def dense_windows(dense: DenseMatches, seen: DataFrame, every: int, group_pairs: int = GROUP_PAIRS) -> DataFrame | None:
    """Windows of the matches that are not made, as input of ``fold_windows``; None if no record meets a rule.

    ``seen`` has ``(rule_id, seen)`` rows for rules to go on with. A window is ``whole`` if
    all its records are among these, and it is not its rule's last one. Groups are counted
    first, and those with many pairs are cut by rule.
    """
    rules, listed = dense.rules, _listed(dense.records, dense.levels)
    sizes = listed.groupBy("node").agg(F.count("*").alias("records"))
    sizes = sizes.join(rules.groupBy("node").agg(F.count("*").alias("rules")), "node")
    pairs = F.col("records") * F.col("rules")
    salts = F.least(F.ceil(pairs / group_pairs), F.col("rules")).cast("int").alias("salts")
    # fewer segments than pairs / group_pairs are cut, so this list is short
    cut = F.collect_list(F.when(pairs > group_pairs, F.struct("node", salts)))
    met = sizes.agg(F.sum(pairs).alias("pairs"), cut.alias("cut")).first()
    if not met["pairs"]:
        return None
    spark = rules.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-met["pairs"] // min(TASK_PAIRS, group_pairs)))
    placed = rules.join(seen, "rule_id", "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("bigint")))
    keys = ["node"]
    if met["cut"]:
        many = F.broadcast(spark.createDataFrame([tuple(r) for r in met["cut"]], "node bigint, salts int"))
        salts, keys = F.coalesce("salts", F.lit(1)), ["node", "salt"]
        placed = placed.join(many, "node", "left").withColumn("salt", F.pmod(F.xxhash64("rule_id"), salts).cast("int"))
        listed = listed.join(many, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    left = listed.select(*keys, "record_id", "at", "position", "first_long").repartition(tasks, *keys)
    right = placed.select(*keys, "rule_id", "offset", "width", "seen").repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_window_fold(every), WINDOW_FIELDS)


def _window_fold(every: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Folds a group's records into windows, rule by rule. Made by a function, so that it travels to the tasks whole."""
    mask = RING_MASK
    names = ["cycle", "pos", "weight", "first_long", "start_ms", "end_ms"]

    def fold(records: pa.Table, rules: pa.Table) -> pa.Table:
        by_arrival = [("at", "ascending"), ("record_id", "ascending")]
        records = records.take(pc.sort_indices(records, sort_keys=by_arrival, null_placement="at_start"))
        position, values = records["position"].to_numpy(), records["first_long"].to_numpy()
        ms = pc.fill_null(records["at"], 0).to_numpy() // 1000
        arcs = [rules[c].to_numpy() for c in ("offset", "width", "seen")]
        found, windows = [], []
        for i, (offset, width, seen) in enumerate(zip(*arcs, strict=True)):
            hits = np.flatnonzero(((position - offset) & mask) < width)
            if not len(hits):
                continue
            # the first window goes on with what was seen before
            first = np.concatenate([[0], np.arange(every - seen % every, len(hits), every)])
            last = np.concatenate([first[1:], [len(hits)]]) - 1
            start = ms[hits[first]]
            start[0] = 0 if seen % every else start[0]
            pos = seen + last
            total = np.add.reduceat(values[hits], first)
            windows.append([pos // every, pos, last - first + 1, total, start, ms[hits[last]]])
            whole = windows[-1][2] == every
            whole[-1] = False
            found.append((np.full(len(pos), i), whole))
        columns = [np.concatenate(c) for c in zip(*windows)] or [np.empty(0, np.int64)] * len(names)
        rule, whole = [np.concatenate(c) for c in zip(*found)] or (np.empty(0, np.int64), np.empty(0, bool))
        ids = rules["rule_id"].combine_chunks().take(pa.array(rule))
        return pa.table([ids, *(pa.array(c) for c in columns), pa.array(whole)], names=["rule_id", *names, "whole"])

    return fold
