"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.llm.archives import ARCHIVE_SQL, page_records, read_archives, write_archives
from ringfold.llm.decontaminate import REPORT_SQL, contamination_report
from ringfold.llm.embeddings import near_embeddings
from ringfold.llm.inputs import fold_of, table
from ringfold.llm.jaccard_join import jaccard_components
from ringfold.llm.language import fit_dictionaries, identify
from ringfold.llm.manifest import MANIFEST_SQL, manifest_report
from ringfold.llm.mixing import MIX_SQL, mix_sources
from ringfold.llm.quality import fit_quality, score_quality
from ringfold.llm.samples import training_rows
from ringfold.llm.substring_dedup import remove_repeats
from ringfold.llm.token_blocks import read_token_files, write_token_files
from ringfold.llm.toxicity import fit_toxicity, score_toxicity
from ringfold.llm.url_filter import judged_urls, rules_sql
from ringfold.llm.vector_codes import CODES_SQL, coded_vectors

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _predictions(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    doc_id = F.col("row.doc_id")
    return scored.select(
        doc_id.alias("doc_id"),
        (fold_of(doc_id, folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), training_rows(5, 0))
    return _predictions(score_toxicity(docs, model, keep=["doc_id"]), 5, 0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = fit_quality(docs, table(spark, sf_dir, "labels"), training_rows(3, 1))
    return _predictions(score_quality(docs, network, keep=["doc_id"]), 3, 1)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return cleaned.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_dictionaries(docs, training_rows(5, 0)))
    held_out = (fold_of(F.col("doc_id"), 5) == 0).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "margin", "rejected")


def op9_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(read_archives(write_archives(table(spark, sf_dir, "pages"))))


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, public_tokenizers.path(TOKENIZER), END_ID))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_vectors(table(spark, sf_dir, "embeddings"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_report(table(spark, sf_dir, "documents"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judged_urls(table(spark, sf_dir, "pages"), rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": REPORT_SQL,
        "op3_mixing": MIX_SQL,
        "op9_archives": ARCHIVE_SQL,
        "op11_codes": CODES_SQL,
        "op12_manifest": MANIFEST_SQL,
        "op13_urls": rules_sql(URL_RULES),
    }
