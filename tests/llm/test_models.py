"""Models: defined results on odd rows, held-out accuracy on the given tables, recall against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.llm import queries as Q
from ringfold.llm.components import connected_components, extend_components
from ringfold.llm.embeddings import near_embeddings
from ringfold.llm.inputs import table
from ringfold.llm.language import fit_dictionaries, identify
from ringfold.llm.quality import estimate_prior, fit_network, fit_quality, score_quality
from ringfold.llm.samples import training_rows
from ringfold.llm.toxicity import fit_toxicity, score_toxicity


def held_out(spark, sf_dir, found, label):
    labels = table(spark, sf_dir, "labels").select("doc_id", label)
    rows = found.where("held_out").join(labels, "doc_id").select(label, "predicted").collect()
    return np.array([tuple(r) for r in rows])


@pytest.fixture(scope="module")
def toxic(spark, sf_dir):
    return Q.op1_toxicity(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def quality(spark, sf_dir):
    return Q.op4_quality(spark, sf_dir).cache()


def test_toxicity_held_out(spark, sf_dir, toxic):
    rows = held_out(spark, sf_dir, toxic, "toxic")
    clean = rows[rows[:, 0] == 0]
    assert (rows[:, 0] == rows[:, 1]).mean() >= 0.9 and (clean[:, 1] == 0).mean() >= 0.95


def test_quality_held_out(spark, sf_dir, quality):
    rows = held_out(spark, sf_dir, quality, "quality")
    good = rows[rows[:, 0] == 1]
    assert (rows[:, 0] == rows[:, 1]).mean() >= 0.85 and (good[:, 1] == 1).mean() >= 0.95


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_scores_are_whole(spark, sf_dir, request, name):
    found = request.getfixturevalue(name)
    assert found.count() == table(spark, sf_dir, "documents").count()
    assert found.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").count() == 0
    folds, held = (5, 0) if name == "toxic" else (3, 1)
    assert found.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held) != F.col("held_out")).count() == 0


def test_language_held_out(spark, sf_dir):
    found = Q.op8_language(spark, sf_dir).where("held_out")
    rows = found.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    assert rows.where("lang = lang_pred").count() / rows.count() >= 0.9


def test_odd_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(37, 1, 1), (74, 0, 0), (37, 0, 0), (None, 1, 1), (9, None, 7)], "doc_id long, quality int, toxic int")
    everything = F.lit(True)
    n = edge_docs.count()
    network = fit_quality(edge_docs, labels, everything)
    scored = score_quality(edge_docs, network)
    assert scored.select("row.*").columns == edge_docs.columns
    assert scored.where("score >= 0 AND score <= 1").count() == n
    assert fit_quality(no_docs, labels, everything) is None
    assert [r.score for r in score_quality(edge_docs, None).select("score").distinct().collect()] == [0.5]
    assert score_quality(no_docs, network).count() == 0
    assert fit_toxicity(edge_docs, labels, everything) is None  # too few labels
    assert score_toxicity(edge_docs, None).where("score = 0").count() == n
    dictionaries = fit_dictionaries(edge_docs, training_rows(5, 0))
    got = {r.doc_id: r for r in identify(edge_docs, dictionaries).collect()}
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    for doc, r in got.items():
        letters = any(map(str.isalpha, texts[doc] or ""))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert fit_dictionaries(no_docs, everything) == {}
    assert {r.lang_pred for r in identify(edge_docs, {}).collect()} == {"und"}
    assert identify(no_docs, dictionaries).count() == 0


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (6000, 4)), rng.normal(-1.5, 1, (1600, 4))
    positive, unlabelled = good[:2000], np.concatenate([good[2000:], bad])
    prior = estimate_prior(positive, unlabelled)
    assert abs(prior - 4000 / 5600) < 0.06
    scores = fit_network(positive, unlabelled, prior).score(unlabelled) >= 0.5
    assert scores[:4000].mean() > 0.97 and scores[4000:].mean() < 0.06


def _vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(24)
        for k in range(12):
            rows.append((len(rows) * 3, (centre + 0.3 * rng.standard_normal(24) * (k > 0)).tolist(), c % 3))
    rows += [(1001 + i, rows[0][1], 0) for i in range(40)]  # many equal vectors
    rows += [(2000, [0.0] * 24, 0), (2001, None, 0), (2002, [1.0, None] + [0.0] * 22, 0), (2003, [float("nan")] + [1.0] * 23, 0)]
    rows += [(2004, [float("inf")] + [1.0] * 23, 0), (2005, rows[0][1], None), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0), (2008, [], 0)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, bucket string")


@pytest.mark.parametrize("piece", [1024, 4])
def test_near_embeddings(spark, piece):
    rows, vectors = _vectors(spark)
    got = {r.vec_id: r for r in near_embeddings(vectors, piece=piece, tables=40).collect()}
    assert len(got) == len(rows)
    sound = [r for r in rows if r[2] is not None and r[1] and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = {r[0]: set() for r in rows}
    for i, a in enumerate(sound):
        for b in sound[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    found, true = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert 0.9 <= found / true <= 1 and all(got[i].n_links <= len(n) for i, n in links.items())
    for i, r in got.items():
        assert r.kept == (r.vec_id == r.component_id)
        if not links[i]:
            assert r.component_id == i
    assert got[1001].n_links >= 40 and got[2006].component_id == 2006 and got[2007].component_id == 2006
    assert near_embeddings(vectors.limit(0)).count() == 0


def _true_links(ids, vectors, labels):
    """Pairs of one label with a cosine of 0.93 or more, by comparing all."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = {}
    for label in np.unique(labels):
        own = np.flatnonzero(labels == label)
        near = (unit[own] @ unit[own].T >= 0.93).sum(axis=1) - 1
        links |= dict(zip(ids[own].tolist(), near.tolist()))
    return links


def _recall(found, want):
    got = {r.vec_id: r.n_links for r in found.collect()}
    assert got.keys() == want.keys() and all(got[i] <= n for i, n in want.items())
    return sum(got.values()) / sum(want.values())


def test_recall_of_the_query(spark, sf_dir):
    """With the query's own tables, on its own table; the small ones have no near pairs."""
    large = os.path.join(os.path.dirname(sf_dir), "check_s")
    if not os.path.isdir(large):
        pytest.skip("no table with near pairs")
    rows = table(spark, large, "embeddings").select("vec_id", "embedding", "label").collect()
    ids, labels = np.array([r.vec_id for r in rows]), np.array([r.label for r in rows])
    want = _true_links(ids, np.array([r.embedding for r in rows], np.float64), labels)
    recall = _recall(Q.op7_embeddings(spark, large), want)
    print("recall", recall, "of", sum(want.values()) // 2, "pairs")
    assert recall >= 0.9


def test_recall_at_the_threshold(spark):
    """Pairs whose cosines are 0.93 to 0.95, with the query's own tables."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.95, (len(a), 1))
    vectors = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * b])
    ids, labels = np.arange(len(vectors)), np.tile(np.arange(len(a)) % 7, 2)
    docs = spark.createDataFrame(
        list(zip(ids.tolist(), vectors.tolist(), labels.tolist())), "vec_id long, embedding array<double>, label int"
    )
    want = _true_links(ids, vectors, labels)
    recall = _recall(near_embeddings(docs), want)
    print("recall", recall, "of", sum(want.values()) // 2, "pairs")
    assert recall >= 0.9


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 200), (7, 7), (300, 301), (302, 301), (None, 5), (4, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 300, 301: 300, 302: 300}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_extended_components(spark):
    rng = np.random.default_rng(3)
    schema, parent = "a long, b long", {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    found = connected_components(spark.createDataFrame([], schema))
    for n in (40, 0, 25, 60):
        edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (n, 2))]
        for a, b in edges:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        found = extend_components(found, spark.createDataFrame(edges, schema))
        got = {r.node: r.component for r in found.collect()}
        assert len(got) == found.count()
        assert all(got.get(x, x) == root(x) for x in parent) and got.keys() <= parent.keys()
