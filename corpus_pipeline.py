"""From raw documents to token files, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ringfold.llm.decontaminate import drop_contaminated
from ringfold.llm.inputs import small_batches, table
from ringfold.llm.jaccard_join import keep_one
from ringfold.llm.mixing import mixed_documents
from ringfold.llm.quality import fit_quality, score_quality
from ringfold.llm.queries import END_ID, TOKENIZER
from ringfold.llm.samples import training_rows
from ringfold.llm.token_blocks import read_token_files, write_token_files
from ringfold.workdir import stored

#: Words that a worker remembers while it writes tokens: a sixth of what it would in a query that
#: does nothing else, as executors are as full as the earlier stages left them.
REMEMBERED_WORDS = 1 << 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    network = fit_quality(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), training_rows(3, 1))
    return score_quality(docs, network).where("score >= 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a Jaccard similarity of 0.8 or more connect."""
    small_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids are in the token files."""
    small_batches(spark)
    files = write_token_files(docs, public_tokenizers.path(TOKENIZER), END_ID, remembered=REMEMBERED_WORDS)
    return read_token_files(files)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token output", tokens),
]

#: Classifiers and tokenizers have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
