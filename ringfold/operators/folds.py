"""Folds of one's own over the matches of a table.

A fold is a function ``(key, state or None, rows) -> (new state, emitted rows)``. It is
called with pandas rows in arrival order, many at a time, and keeps nothing itself. A
key's rows may come in several calls; the state passes between them.

Such a fold is sequential. One whose states can be merged is not: with ``merge(earlier,
later)``, the state after both of two stretches of rows, a rule's rows are cut into parts,
each part is folded from nothing for its state alone, the states are summed up part by
part, and each part is folded again from the state that the parts before it leave.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringfold.operators.digest import ARRIVAL, SplitMatches, add_windows, arrival_index
from ringfold.workdir import stored

Fold = Callable[[object, tuple | None, pd.DataFrame], tuple[tuple, list[tuple]]]
Merge = Callable[[tuple, tuple], tuple]

#: Column with a pickled state: of a row that only brings the state its key starts from.
STATE = "_state"


def field_names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(",")]


def _key_runs(batch: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """Where a batch is cut, as the key changes: key, first row, row after the last."""
    columns = [batch[k].to_numpy() for k in keys]
    changed = np.zeros(max(0, len(batch) - 1), dtype=bool)
    for column in columns:
        changed |= column[1:] != column[:-1]
    cuts = np.flatnonzero(changed) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
        if lo < hi:
            yield tuple(column[lo] for column in columns), lo, hi


def sorted_fold(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fold: Fold,
    output_schema: str,
    starts: DataFrame | None = None,
    named: int | None = None,
    hidden: Sequence[str] = (),
) -> DataFrame:
    """Run a fold per key. Rows stream through sorted tasks; no key is ever held whole.

    ``starts`` has the keys and a column ``_state``: such keys start from that state
    instead of None. The fold is called with the first ``named`` keys, with all by default,
    and does not see the columns ``hidden``. Columns are dropped once per batch, as a batch
    may hold thousands of keys.
    """
    keys, names = list(keys), field_names(output_schema)
    named = named or len(keys)
    hidden = [*hidden, STATE]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            given = batch[STATE].to_numpy() if STATE in batch else None
            rows = batch.drop(columns=hidden, errors="ignore")
            for own, lo, hi in _key_runs(batch, keys):
                if own != key:
                    key, state = own, None
                if given is not None and given[lo] is not None:
                    state, lo = pickle.loads(given[lo]), lo + 1
                if lo < hi:
                    state, events = fold(own[0] if named == 1 else own[:named], state, rows.iloc[lo:hi])
                    out.extend(events)
            if out:
                yield pd.DataFrame(out, columns=names)

    if starts is not None:
        rows = rows.withColumn(STATE, F.lit(None).cast("binary")).unionByName(_start_rows(rows, keys, starts))
        order = [F.col(STATE).isNull(), *order]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, output_schema)


def _start_rows(rows: DataFrame, keys: Sequence[str], starts: DataFrame) -> DataFrame:
    """A row per start state. Its other columns hold a value of their type, as nulls would turn integers to floats."""

    def blank(field: T.StructField) -> Column:
        if field.name in (*keys, STATE):
            return F.col(field.name)
        if isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            return F.lit(0).cast(field.dataType).alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return F.timestamp_seconds(F.lit(0)).alias(field.name)
        return F.lit(None).cast(field.dataType).alias(field.name)

    return starts.select(*[blank(f) for f in rows.schema], STATE)


def part_states(rows: DataFrame, fold: Fold) -> DataFrame:
    """The state that each ``(rule_id, part)`` leaves when it is folded from nothing: one row per part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done, rows = [], batch.drop(columns="part")
            for own, lo, hi in _key_runs(batch, ["rule_id", "part"]):
                if own != key:
                    if key is not None:
                        done.append((*key, pickle.dumps(state)))
                    key, state = own, None
                state, _ = fold(own[0], state, rows.iloc[lo:hi])
            if done:
                yield pd.DataFrame(done, columns=["rule_id", "part", STATE])
        if key is not None:
            yield pd.DataFrame([(*key, pickle.dumps(state))], columns=["rule_id", "part", STATE])

    ordered = rows.repartition("rule_id", "part").sortWithinPartitions("rule_id", "part", *ARRIVAL)
    return ordered.mapInPandas(run, f"rule_id string, part int, {STATE} binary")


def start_states(states: DataFrame, merge: Merge) -> DataFrame:
    """The state before each part but a rule's first: what the earlier parts leave together.

    A rule has few parts (its rows over the rows of a part), whose states pass through
    one task in order and are not held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, total = None, None
        for batch in batches:
            rows: list[tuple] = []
            for own, part, state in zip(*(batch.column(c).to_pylist() for c in ("rule_id", "part", STATE)), strict=True):
                if own != rule:
                    rule, total = own, pickle.loads(state)
                else:
                    rows.append((own, part, pickle.dumps(total)))
                    total = merge(total, pickle.loads(state))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["rule_id", "part", STATE])

    ordered = states.repartition("rule_id").sortWithinPartitions("rule_id", "part")
    return ordered.mapInArrow(run, f"rule_id string, part int, {STATE} binary")


def merge_fold(
    matches: DataFrame | SplitMatches, fold: Fold, merge: Merge, output_schema: str, summary: Fold | None = None
) -> DataFrame:
    """What :func:`batch_fold` gives, with the rules that were split folded by many tasks each.

    ``merge(earlier, later)`` must give the state of both stretches of rows in one, for any
    cut; it need not be commutative. ``summary`` is a fold that leaves the same states and
    emits nothing, where that is cheaper than ``fold`` itself. Rows of split rules are read
    and sorted twice, those of other rules once. A rule with rows is called with all
    of them, in arrival order, and never with none. An empty table gives no rows.
    """
    if not isinstance(matches, SplitMatches):
        return batch_fold(matches, fold, output_schema)
    states = stored(part_states(matches.rows.where("part > 0"), summary or fold), "part-states")
    starts = stored(start_states(states, merge), "start-states")
    return sorted_fold(matches.rows, ["rule_id", "part"], ARRIVAL, fold, output_schema, starts, 1, ["part"])


def batch_fold(matches: DataFrame, fold: Fold, output_schema: str) -> DataFrame:
    """One fold per rule over all its matches, which is as sequential as the fold itself.

    The rows of one rule pass through one task. When the fold restarts every R records,
    use :func:`window_fold`, which spreads a rule's windows over tasks; when its states can
    be merged, :func:`merge_fold`, which spreads a rule's rows.
    """
    return sorted_fold(matches, ["rule_id"], ARRIVAL, fold, output_schema)


def window_fold(
    matches: DataFrame | SplitMatches,
    every: int,
    fold: Fold,
    output_schema: str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One fold per window of ``every`` records, called with the key ``(rule_id, cycle)``.

    Rows carry their place ``pos``; a window is full when it has seen ``every`` places.
    A task never depends on how many windows a rule has. ``columns`` names what the fold
    reads, all by default; only that is shuffled and cut into windows.
    """
    placed, keys = add_windows(arrival_index(matches), every), ["rule_id", "cycle"]
    if columns is None:
        return sorted_fold(placed, keys, ["pos"], fold, output_schema)
    unread = [c for c in (*keys, "pos") if c not in columns]
    placed = placed.select(*unread, *columns)
    return sorted_fold(placed, keys, ["pos"], fold, output_schema, hidden=unread)
