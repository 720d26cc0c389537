"""The whole dataflow on a table: position, fan-out, shuffle by rule, fold."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ringfold.functions.payload import DIGEST_BYTES
from ringfold.operators.digest import MAX_ROWS, SplitMatches, count_window_digest, split_hot_rules
from ringfold.operators.fanout import match_records, prepare_records
from ringfold.workdir import stored


def large_matches(matches: DataFrame, n_records: int, max_rows: int = MAX_ROWS) -> DataFrame | SplitMatches:
    """Matches ready for numbering.

    A rule matches a record at most once, so with few records no rule can be too large
    for a task and one shuffle does; the same holds for few matches. Otherwise the matches, a small part of the input's
    bytes, are stored and the rules with too many rows are split.
    """
    if n_records <= max_rows:
        return matches
    matches = stored(matches, "matches")
    if matches.count() <= max_rows:
        return matches
    return split_hot_rules(matches, max_rows) or matches


def digest_records(
    records: DataFrame,
    rules: DataFrame,
    every: int = 10,
    state_bytes: int = DIGEST_BYTES,
    random_phase: bool = False,
    hash: str = "xxhash64",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Digests of all rules over ``(record_id, ts, data)`` records."""
    matches = match_records(prepare_records(records, state_bytes, random_phase, hash), rules)
    return count_window_digest(large_matches(matches, records.count(), max_rows), every, state_bytes)
