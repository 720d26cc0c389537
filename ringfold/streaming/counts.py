"""A running counter per rule on a stream, computed per micro-batch with the batch operators.

The records that take a rule's count past a multiple of ``every`` follow from the count
before the batch and their rank in it, so a batch gives several events of one rule.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ringfold.functions.payload import LONG_BYTES, require_state_bytes
from ringfold.operators.digest import MAX_ROWS, arrival_index, check_every, count_events
from ringfold.sources.streams import write_batch
from ringfold.streaming.settings import keep_settings
from ringfold.streaming.tables import StateTables


class CountSink(StateTables):
    """Micro-batch function: reads and writes the counts, stores the events."""

    schema = "rule_id string, seen bigint, batch_id bigint"

    def __init__(self, path: str, every: int, state_bytes: int = LONG_BYTES, max_rows: int = MAX_ROWS) -> None:
        super().__init__(path, max_rows)
        check_every(every)
        self.every = every
        self.state_bytes = require_state_bytes(state_bytes, LONG_BYTES)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = self._state(batch, batch_id).select("rule_id", "seen")
        batch = batch.select("rule_id", "ts", "record_id").persist()
        numbered = arrival_index(self._sized(batch), before).persist()
        try:
            write_batch(count_events(numbered, self.every, self.state_bytes), self.events, batch_id)
            own = numbered.groupBy("rule_id").agg((F.max("idx") + 1).alias("seen"))
            after = before.unionByName(own).groupBy("rule_id").agg(F.max("seen").alias("seen"))
            after = after.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            after.write.mode("overwrite").parquet(self._slot(batch_id))
        finally:
            numbered.unpersist()
            batch.unpersist()


def start_count_stream(
    matches: DataFrame,
    path: str,
    checkpoint: str,
    every: int = 10,
    state_bytes: int = LONG_BYTES,
    max_rows: int = MAX_ROWS,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Write the counter events of a match stream below ``path``; see :class:`CountSink`."""
    sink = CountSink(path, every, state_bytes, max_rows)
    keep_settings(matches.sparkSession, path, {"engine": "counts", "every": every, "state_bytes": state_bytes})
    return (
        matches.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
