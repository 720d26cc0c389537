"""Count-window digests of a stream, computed per micro-batch with the batch operators.

The open window of each rule is kept as a table next to the output. A micro-batch is
numbered from where its rules stand, folded together with the open windows, and leaves
full windows as events and the rest as the next table. There is no call per rule and no
Python in the data path, and a rule that fills most of a micro-batch is split like in a
batch job. Only dense rules, if they are handed on as such, are folded in numpy: a row per
window, of which just those that may go on in another micro-batch meet the open windows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ringfold.functions.payload import DIGEST_BYTES, require_state_bytes
from ringfold.operators.dense import DenseMatches, dense_windows
from ringfold.operators.digest import (
    MAX_ROWS,
    SplitMatches,
    arrival_index,
    complete,
    fold_windows,
    pack_digests,
    weighted,
)
from ringfold.sources.streams import write_batch
from ringfold.streaming.settings import keep_settings
from ringfold.streaming.tables import StateTables

STATE_FIELDS = (
    "rule_id string, last_pos bigint, n_records bigint, total bigint, start_ms bigint, end_ms bigint, payload binary"
)
STATE_SCHEMA = STATE_FIELDS + ", batch_id bigint"


def _seen(state: DataFrame) -> DataFrame:
    return state.select("rule_id", (F.col("last_pos") + 1).alias("seen"))


def fold_batch(
    matches: DataFrame | SplitMatches,
    state: DataFrame,
    every: int,
    state_bytes: int = DIGEST_BYTES,
    parts: DataFrame | None = None,
) -> DataFrame:
    """Windows of one micro-batch, continuing the open ones of ``state``.

    ``parts`` are windows of other rules, folded in part.
    """
    rows = weighted(arrival_index(matches, _seen(state)), every)
    if parts is not None:
        rows = rows.unionByName(parts)
    kept = [
        "rule_id",
        F.expr(f"last_pos div {every}").alias("cycle"),
        F.col("last_pos").alias("pos"),
        F.col("n_records").alias("weight"),
        F.col("total").alias("first_long"),
        "start_ms",
        "end_ms",
    ]
    if "prefix" in rows.columns:
        kept.append(F.col("payload").alias("prefix"))
    return fold_windows(rows.unionByName(state.select(*kept)), state_bytes)


def full_windows(windows: DataFrame, every: int) -> DataFrame:
    """Digests to emit. A closed window carried over as state has no records and is skipped."""
    n = F.lit(every).cast("bigint").alias("n")
    full = windows.where(complete(every) & (F.col("n_records") > 0))
    return full.select("rule_id", "cycle", n, "n_records", "total", "start_ms", "end_ms", "payload")


def whole_windows(folded: DataFrame, every: int) -> DataFrame:
    """Digests of the windows of dense rules that are full by themselves."""
    return folded.where("whole").select(
        "rule_id",
        "cycle",
        F.lit(every).cast("bigint").alias("n"),
        F.col("weight").alias("n_records"),
        F.col("first_long").alias("total"),
        "start_ms",
        "end_ms",
        F.lit(b"").alias("payload"),
    )


def open_windows(windows: DataFrame, every: int, batch_id: int) -> DataFrame:
    """Where each rule stands: its last place, and the open window's fields if there is one."""
    fields = ["n_records", "total", "start_ms", "end_ms", "payload"]
    last = windows.groupBy("rule_id").agg(F.max_by(F.struct("last_pos", *fields), "last_pos").alias("w"))
    closed = F.col("w.last_pos") % every == every - 1
    empty = {"payload": F.col("w.payload")} | {f: F.lit(0).cast("bigint") for f in fields[:-1]}
    return last.select(
        "rule_id",
        F.col("w.last_pos").alias("last_pos"),
        *[F.when(closed, empty[f]).otherwise(F.col(f"w.{f}")).alias(f) for f in fields],
        F.lit(batch_id).cast("bigint").alias("batch_id"),
    )


class DigestSink(StateTables):
    """Micro-batch function: reads and writes the open windows, stores the events.

    The matches of a micro-batch are counted, and rules with more than ``max_rows`` of
    them are split. ``packed`` stores events as ``(key, value)`` bytes. Dense matches have
    no room for more than the fixed fields of a state.
    """

    schema = STATE_SCHEMA

    def __init__(
        self,
        path: str,
        every: int,
        state_bytes: int = DIGEST_BYTES,
        max_rows: int = MAX_ROWS,
        packed: bool = False,
    ) -> None:
        super().__init__(path, max_rows)
        self.every = every
        self.state_bytes = require_state_bytes(state_bytes)
        self.packed = packed

    def __call__(self, batch: DataFrame | DenseMatches, batch_id: int) -> None:
        rows = batch.rows if isinstance(batch, DenseMatches) else batch
        state = self._state(rows, batch_id)
        folded = parts = None
        if isinstance(batch, DenseMatches):
            if self.state_bytes != DIGEST_BYTES:
                raise ValueError(f"dense matches need a state of {DIGEST_BYTES} bytes, not {self.state_bytes}")
            folded = dense_windows(batch, _seen(state), self.every)
        if folded is not None:
            folded = folded.persist()
            parts = folded.where(~F.col("whole")).drop("whole")
        rows = rows.persist()
        windows = fold_batch(self._sized(rows), state, self.every, self.state_bytes, parts).persist()
        try:
            events = full_windows(windows, self.every)
            if folded is not None:
                events = events.unionByName(whole_windows(folded, self.every))
            write_batch(pack_digests(events, self.state_bytes) if self.packed else events, self.events, batch_id)
            open_windows(windows, self.every, batch_id).write.mode("overwrite").parquet(self._slot(batch_id))
        finally:
            for table in (windows, rows, folded):
                if table is not None:
                    table.unpersist()


def start_digest_stream(
    matches: DataFrame,
    path: str,
    checkpoint: str,
    every: int = 10,
    state_bytes: int = DIGEST_BYTES,
    max_rows: int = MAX_ROWS,
    packed: bool = False,
    trigger: Mapping[str, object] | None = None,
    settings: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Write the digests of a match stream below ``path``; see :class:`DigestSink`.

    A restart must come with the same ``every`` and ``state_bytes``, and the same
    ``settings`` if any, which are kept beside the state.
    """
    sink = DigestSink(path, every, state_bytes, max_rows, packed)
    layout = {"engine": "tables", "every": every, "state_bytes": state_bytes, **(settings or {})}
    keep_settings(matches.sparkSession, path, layout)
    return (
        matches.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
