"""Bounded samples of labelled and unlabelled documents for fitting classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfold.llm.features import shape
from ringfold.llm.inputs import fold_of


def drawn(doc_id: Column, share: float, seed: int) -> Column:
    """True for about ``share`` of ids, the same ones in every run."""
    return (F.xxhash64(doc_id, F.lit(seed)).cast("double") / 2.0**64 + 0.5) < share


def labelled_ids(labels: DataFrame, label: str, training: Column, most: int, id_col: str = "doc_id") -> DataFrame:
    """About ``most`` ids at most with a 0/1 label among those that ``training`` admits.

    ``training`` is over the column ``doc_id``. Other labels, and nulls, are left out; of
    several labels of one id the largest counts.
    """
    rows = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & training)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.where(drawn(F.col("doc_id"), most / max(1, rows.count()), 11))


def training_rows(folds: int, held_out: int) -> Column:
    return fold_of(F.col("doc_id"), folds) != held_out


def shape_rows(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and ``features``, the dense features of column ``text``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shape(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [pa.array(rows, pa.list_(pa.float64()))], names=[*carry, "features"]
            )

    rows = docs.select(*carry, "text")
    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry]
    return rows.mapInArrow(measure, ", ".join([*fields, "features array<double>"]))

