"""State of a stream that is a table per micro-batch.

A batch writes the slot ``batch_id % 2`` and reads the other one, so a replayed batch
finds the state it started from and writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.operators.digest import MAX_ROWS, SplitMatches, split_hot_rules


class StateTables:
    """Where a micro-batch function keeps its state, with a ``batch_id`` in each row, and its events."""

    schema: str

    def __init__(self, path: str, max_rows: int = MAX_ROWS) -> None:
        self.path = path.rstrip("/")
        self.max_rows = max_rows

    @property
    def events(self) -> str:
        return f"{self.path}/events"

    def _slot(self, batch_id: int) -> str:
        return f"{self.path}/state/slot{batch_id % 2}"

    def _state(self, batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        if batch_id == 0:
            return spark.createDataFrame([], self.schema)
        state = spark.read.schema(self.schema).parquet(self._slot(batch_id - 1))
        found = state.agg(F.min("batch_id"), F.max("batch_id")).first()
        if any(b not in (None, batch_id - 1) for b in found):
            raise ValueError(f"state below {self.path} is of batch {found[1]}, not {batch_id - 1}")
        return state

    def _sized(self, batch: DataFrame) -> DataFrame | SplitMatches:
        if batch.count() <= self.max_rows:
            return batch
        return split_hot_rules(batch, self.max_rows) or batch
