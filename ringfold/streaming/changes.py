"""Rules that change while a stream runs.

Rule tables are published in versions. A micro-batch takes the last version there is when
it first starts and records it before anything else, so a batch that is run again matches
the same rules, and a change takes effect at the border of two batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.commits import CommitLog
from ringfold.operators.dense import DENSE_COLUMNS, DenseMatches, dense_levels, dense_rules
from ringfold.operators.fanout import BROADCAST_BYTES, match_records
from ringfold.operators.rules import rule_nodes


class RuleVersions:
    """Versions of a rule table and its index, in a folder. Published versions never change."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self.path = spark, path.rstrip("/")
        self._log = CommitLog(spark, f"{self.path}/versions")

    def publish(self, rules: DataFrame) -> int:
        """Store the rules as the next version; the folder has one writer at a time."""
        number = len(self._log.texts())
        folder = f"{number}-{uuid.uuid4().hex}"
        rules.write.parquet(f"{self.path}/{folder}/rules")
        kept = self._spark.read.parquet(f"{self.path}/{folder}/rules")
        rule_nodes(kept).write.parquet(f"{self.path}/{folder}/nodes")
        if self._log.put(f"{number:019}", folder) != folder:
            raise ValueError(f"version {number} of {self.path} was published by another writer")
        return number

    def latest(self) -> int:
        """Number of the last version; versions are numbered from 0."""
        last = len(self._log.texts()) - 1
        if last < 0:
            raise ValueError(f"no rules are published below {self.path}")
        return last

    def read(self, version: int) -> tuple[DataFrame, DataFrame]:
        """Rules and index rows of a version."""
        folder = f"{self.path}/{self._log.get(f'{version:019}')}"
        return self._spark.read.parquet(f"{folder}/rules"), self._spark.read.parquet(f"{folder}/nodes")


class ChangingRules:
    """Micro-batch function: matches prepared records against a version, and hands the matches on.

    ``path`` holds which version a batch took; ``then`` is the function of the matches and
    the batch's number, such as a sink of digests. With ``dense``, levels of rules that
    match a record more than that many times are handed on as ``DenseMatches``, which a sink
    of digests folds without a row per match.
    """

    def __init__(
        self,
        rules: str,
        path: str,
        then: Callable[[DataFrame | DenseMatches, int], None],
        broadcast_bytes: int = BROADCAST_BYTES,
        dense: float | None = None,
    ) -> None:
        self.rules, self.path, self.then = rules, path.rstrip("/"), then
        self.broadcast_bytes, self.dense = broadcast_bytes, dense

    def version(self, spark: SparkSession, batch_id: int) -> int:
        log = CommitLog(spark, f"{self.path}/taken")
        taken = log.get(f"{batch_id:019}")
        if taken is None:
            taken = log.put(f"{batch_id:019}", str(RuleVersions(spark, self.rules).latest()))
        return int(taken)

    def __call__(self, records: DataFrame, batch_id: int) -> None:
        spark = records.sparkSession
        rules, nodes = RuleVersions(spark, self.rules).read(self.version(spark, batch_id))
        dense = self.dense is not None and set(records.columns) <= DENSE_COLUMNS
        levels = dense_levels(rules, self.dense) if dense else []
        if not levels:
            self.then(match_records(records, rules, broadcast_bytes=self.broadcast_bytes, nodes=nodes), batch_id)
            return
        records, others = records.persist(), nodes.where(~F.col("level").isin(levels))
        try:
            matches = match_records(records, rules, broadcast_bytes=self.broadcast_bytes, nodes=others)
            self.then(DenseMatches(matches, records, dense_rules(rules, levels), levels), batch_id)
        finally:
            records.unpersist()
