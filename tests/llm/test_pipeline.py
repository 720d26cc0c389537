"""The pipeline's stages on a small table."""

import corpus_pipeline as P
import pytest

from ringfold.llm.decontaminate import find_benchmark
from ringfold.llm.inputs import table
from ringfold.llm.jaccard_join import jaccard_components
from ringfold.llm.mixing import mix_sources


@pytest.fixture(scope="module")
def steps(spark, small_dir, tmp_path_factory):
    """Every stage's input and output, stored."""
    docs = table(spark, small_dir, "documents")
    out = []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        stage(spark, docs, small_dir).write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_columns(steps, spark, small_dir):
    columns = table(spark, small_dir, "documents").columns
    for before, after in steps[:-1]:
        assert before.columns == columns and after.columns == columns
    assert [name for name, _ in P.STAGES] == [
        "quality classifier", "near duplicates", "benchmark decontamination", "mixing sources", "token output"
    ]


def test_stages_take_effect(steps, spark, small_dir):
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, d5) = steps
    bad = table(spark, small_dir, "labels").where("quality = 0")
    assert d1.join(bad, "doc_id").count() < d0.join(bad, "doc_id").count() or d1.count() <= d0.count()
    assert d1.count() >= 0.6 * d0.count()
    kept = jaccard_components(d1).where("doc_id = component_id")
    assert sorted(r.doc_id for r in d2.collect()) == sorted(r.doc_id for r in kept.collect())
    benchmark = table(spark, small_dir, "benchmark")
    clean = find_benchmark(d2, benchmark).where("NOT contaminated").select("row.doc_id")
    assert sorted(r.doc_id for r in d3.collect()) == sorted(r.doc_id for r in clean.collect())
    copies = {r.doc_id: r.copies for r in mix_sources(d3).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in d4.groupBy("doc_id").count().collect()}
    assert got == copies
    assert d5.count() == d4.count()


def test_run(steps, spark, small_dir):
    got = P.run(spark, small_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[-1][1].collect()))
