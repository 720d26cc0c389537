"""Count-window digests: fold every R records of a rule into one event.

Rows of a rule are taken in the order ``(ts, record_id)``, those without a time first. The window of a row follows
from its number within the rule, so a digest is a numbering and a grouped aggregate.

Numbering sorts a rule's rows in one task. That is right for the many rules with few
rows and wrong for a rule that holds a large share of all of them. Rules above
``max_rows`` are therefore cut into range partitions first, numbered inside each, and
moved up by what the partitions before hold. :func:`split_hot_rules` does the cutting;
its result carries a ``part`` column and a small table of starts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringfold.functions.payload import (
    DIGEST_BYTES,
    LONG_BYTES,
    counter_pack,
    event_pack,
    require_state_bytes,
    wrapping_sum,
)
from ringfold.functions.timing import epoch_ms
from ringfold.workdir import stored

MAX_ROWS = 1 << 22
ARRIVAL = ("ts", "record_id")
MAX_EVERY = 1 << 30


@dataclass(frozen=True)
class SplitMatches:
    """Matches cut into parts of bounded size, and where each later part starts.

    ``starts`` has a row ``(rule_id, part, start, phase_hash)`` per part of a hot rule.
    """

    rows: DataFrame
    starts: DataFrame


def split_hot_rules(matches: DataFrame, max_rows: int = MAX_ROWS) -> SplitMatches | None:
    """Cut the rules with more than ``max_rows`` matches into parts; None if there are none.

    ``matches`` is read several times: pass a stored table when it is costly. The hot
    rows are range-partitioned by rule and time and stored with their part's number, so
    the numbers hold whatever is recomputed later. There are fewer hot rules than
    ``rows / max_rows``, and about as many parts, which bounds what is broadcast.
    """
    counts = matches.groupBy("rule_id").agg(F.count("*").alias("n")).where(F.col("n") > max_rows)
    hot = stored(counts, "hot-rules")
    hot_rows = hot.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not hot_rows:
        return None
    parts = 2 * -(-hot_rows // max_rows)
    ids = F.broadcast(hot.select("rule_id"))
    ranged = (
        matches.join(ids, "rule_id", "left_semi")
        .repartitionByRange(parts, "rule_id", *ARRIVAL)
        .withColumn("part", F.spark_partition_id() + 1)
    )
    ranged = stored(ranged, "hot-matches")
    first = [F.min_by("phase_hash", F.struct(*ARRIVAL)).alias("first_phase")] if "phase_hash" in matches.columns else []
    pieces = ranged.groupBy("rule_id", "part").agg(F.count("*").alias("n"), *first)
    before = W.partitionBy("rule_id").orderBy("part")
    starts = pieces.select(
        "rule_id",
        "part",
        F.coalesce(F.sum("n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        *([F.first("first_phase").over(before).alias("rule_phase")] if first else []),
    )
    cold = matches.join(ids, "rule_id", "left_anti").withColumn("part", F.lit(0))
    return SplitMatches(cold.unionByName(ranged), stored(starts, "hot-starts"))


def arrival_index(matches: DataFrame | SplitMatches, seen: DataFrame | None = None) -> DataFrame:
    """Number each rule's matches from 0 in arrival order, as column ``idx``.

    With a ``phase_hash`` column, ``rule_phase`` is that of the rule's first match.
    ``seen`` has ``(rule_id, seen)`` rows for rules to go on with: their numbers start at
    ``seen``, and their phase is 0, since it only places the first match ever.
    """
    split = isinstance(matches, SplitMatches)
    rows = matches.rows if split else matches
    keys = ["rule_id", "part"] if split else ["rule_id"]
    phased = "phase_hash" in rows.columns
    w = W.partitionBy(*keys).orderBy(*ARRIVAL)
    numbered = rows.withColumn("own_idx", (F.row_number().over(w) - 1).cast("bigint"))
    idx, phase = F.col("own_idx"), F.col("own_phase")
    if phased:
        numbered = numbered.withColumn("own_phase", F.first("phase_hash").over(w))
    if split:
        starts = matches.starts
        if phased:
            starts = starts.withColumnRenamed("rule_phase", "hot_phase")
            phase = F.coalesce("hot_phase", "own_phase")
        numbered = numbered.join(F.broadcast(starts), keys, "left")
        idx = idx + F.coalesce("start", F.lit(0))
    if seen is not None:
        if split:
            # one row per part, so that the join keeps the parts where they are
            parts = F.broadcast(matches.starts.select(*keys))
            seen = seen.withColumn("part", F.lit(0)).unionByName(seen.join(parts, "rule_id"))
        numbered = numbered.join(seen, keys, "left")
        idx = idx + F.coalesce("seen", F.lit(0))
        phase = F.when(F.col("seen").isNull(), phase).otherwise(0)
    kept = [c for c in rows.columns if c != "part"]
    return numbered.select(*kept, idx.alias("idx"), *([phase.alias("rule_phase")] if phased else []))


def partition_by_rule(matches: DataFrame | SplitMatches, partitions: int | None = None) -> DataFrame:
    """Shuffle matches by rule; a split rule gets a place for each of its parts."""
    split = isinstance(matches, SplitMatches)
    rows, keys = (matches.rows, ["rule_id", "part"]) if split else (matches, ["rule_id"])
    return rows.repartition(partitions, *keys) if partitions else rows.repartition(*keys)


def check_every(every: int) -> None:
    if not 1 <= every <= MAX_EVERY:
        raise ValueError(f"every must be between 1 and {MAX_EVERY}, not {every}")


def running_count_events(matches: DataFrame | SplitMatches, every: int, state_bytes: int = LONG_BYTES) -> DataFrame:
    """Count each rule's records without reset; an event at every ``every``-th one."""
    check_every(every)
    require_state_bytes(state_bytes, LONG_BYTES)
    return count_events(arrival_index(matches), every, state_bytes)


def count_events(numbered: DataFrame, every: int, state_bytes: int = LONG_BYTES) -> DataFrame:
    """The events of numbered matches."""
    n = F.col("idx") + 1
    return numbered.where(n % every == 0).select(
        "rule_id", n.alias("n"), "ts", "record_id", counter_pack(n, state_bytes).alias("value")
    )


def add_windows(numbered: DataFrame, every: int) -> DataFrame:
    """From a row's number to its window ``cycle`` and its place ``pos`` in the sequence.

    With a random phase the rule's first window starts at a place other than 0, which
    follows from the first record, so that rules do not fire together.
    """
    phase = F.pmod(F.col("rule_phase"), F.lit(every)) if "rule_phase" in numbered.columns else F.lit(0)
    pos = (F.col("idx") + phase).cast("bigint")
    return numbered.withColumn("pos", pos).withColumn("cycle", F.expr(f"pos div {every}"))


def fold_windows(rows: DataFrame, state_bytes: int = DIGEST_BYTES) -> DataFrame:
    """Aggregate rows to digest fields per ``(rule_id, cycle)``; open windows included.

    A row carries the ``weight`` of records it stands for, so that the open window of
    an earlier batch can be one more row. All aggregates combine before the shuffle.
    """
    room = state_bytes - DIGEST_BYTES
    first = [
        F.sum("weight").alias("n_records"),
        wrapping_sum(F.col("first_long"), 32).alias("total"),
        F.min_by("start_ms", "pos").alias("start_ms"),
        F.max_by("end_ms", "pos").alias("end_ms"),
        F.max("pos").alias("last_pos"),
    ]
    if not room:
        return rows.groupBy("rule_id", "cycle").agg(*first).withColumn("payload", F.lit(b""))
    # Of records with equally long prefixes only the last one can be seen, so at most
    # room + 1 layers per window reach the overlay, whatever the size of the window.
    layers = rows.groupBy("rule_id", "cycle", F.length("prefix").alias("size")).agg(
        *first, F.min("pos").alias("first_pos"), F.max_by("prefix", "pos").alias("prefix")
    )
    merged = layers.groupBy("rule_id", "cycle").agg(
        F.sum("n_records").alias("n_records"),
        wrapping_sum(F.col("total"), 32).alias("total"),
        F.min_by("start_ms", "first_pos").alias("start_ms"),
        F.max_by("end_ms", "last_pos").alias("end_ms"),
        F.max("last_pos").alias("last_pos"),
        F.sort_array(F.collect_list(F.struct("last_pos", F.hex("prefix").alias("digits")))).alias("layers"),
    )
    return merged.withColumn("payload", F.unhex(overlay(F.col("layers"), room))).drop("layers")


def overlay(layers: Column, room: int) -> Column:
    """Lay hex strings over each other, oldest first: a shorter one leaves the older tail."""
    return F.aggregate(
        layers,
        F.lit("0" * (2 * room)),
        lambda under, e: F.concat(e["digits"], F.substring(under, F.length(e["digits"]) + 1, F.lit(2 * room))),
    )


def weighted(numbered: DataFrame, every: int) -> DataFrame:
    """Single records as input of :func:`fold_windows`.

    A window's start time is stored by its first place only. A phased first window
    begins after that place, so its start stays 0. A record without a time has time 0.
    """
    ms = F.coalesce(epoch_ms(F.col("ts")), F.lit(0))
    return add_windows(numbered, every).select(
        "rule_id",
        "cycle",
        "pos",
        F.lit(1).cast("bigint").alias("weight"),
        "first_long",
        F.when(F.col("pos") % every == 0, ms).otherwise(F.lit(0)).cast("bigint").alias("start_ms"),
        ms.alias("end_ms"),
        *(["prefix"] if "prefix" in numbered.columns else []),
    )


def complete(every: int) -> Column:
    """True for a window whose last place is filled."""
    return F.col("last_pos") % every == every - 1


def count_window_digest(
    matches: DataFrame | SplitMatches, every: int = 10, state_bytes: int = DIGEST_BYTES
) -> DataFrame:
    """One row per full window of ``every`` records of a rule; open windows give none.

    ``n`` is always ``every``. ``n_records`` differs from it only in a phased first
    window, which sums fewer records.
    """
    check_every(every)
    require_state_bytes(state_bytes)
    rows = weighted(arrival_index(matches), every)
    return (
        fold_windows(rows, state_bytes)
        .where(complete(every))
        .select(
            "rule_id",
            "cycle",
            F.lit(every).cast("bigint").alias("n"),
            "n_records",
            "total",
            "start_ms",
            "end_ms",
            "payload",
        )
    )


def pack_digests(digests: DataFrame, state_bytes: int = DIGEST_BYTES, carry: Sequence[str] = ()) -> DataFrame:
    """Digests as keyed events ``(key, value)`` for a sink, and any columns to carry along."""
    value = event_pack(*[F.col(c) for c in ("n", "total", "start_ms", "end_ms", "payload")], state_bytes)
    return digests.select(F.col("rule_id").alias("key"), value.alias("value"), *carry)
