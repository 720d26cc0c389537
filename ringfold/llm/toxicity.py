"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of learnt lexicons (whole words, and beginnings of words for
inflected and compound forms), closeness to second persons, and the shape of the text:
capitals, punctuation, obfuscated words. Labelled rows fall into three parts by a hash of
their ids: one for the lexicons, one for the trees, one for the calibration.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfold.llm.features import SECOND_PERSON, shape
from ringfold.llm.samples import labelled_ids
from ringfold.workdir import stored

#: Labelled documents that are learnt from, and entries of a lexicon.
MOST_LABELLED = 24_000
MOST_ENTRIES = 4_000
#: A lexicon entry is in so many of its documents at least, and so many times likelier in toxic ones.
LEAST_DOCUMENTS = 4
LEAST_LOG_ODDS = 1.0
#: Letters of a word's beginning.
STEMS = (4, 5, 6)
#: Words to either side in which a second person counts as close.
NEAR = 3
#: Different words whose odds a task remembers.
REMEMBERED_WORDS = 200_000
TREES = 20
DEPTH = 4

_WORDS = re.compile(r"[^\W_]+")
_MARKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": "", "!": "i"})
_INNER = re.compile(r"(?<=[^\W\d_])[0134578@$*!](?=[^\W\d_])")


class ToxicityModel(NamedTuple):
    words: dict[str, float]
    stems: dict[str, float]
    trees: GBTClassificationModel
    calibration: IsotonicRegressionModel


def _words(text: str) -> list[str]:
    """Lower-case words; digits and marks between letters are read as the letters they stand for."""
    plain = _INNER.sub(lambda m: m[0].translate(_MARKS), text) if _INNER.search(text) else text
    return _WORDS.findall(plain.lower())


def _stems(word: str) -> list[str]:
    return [word[:n] for n in STEMS if len(word) >= n]


class Lexicons:
    """Log odds of words and of beginnings of words; remembers the words it has met."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self._words, self._stems = words, stems
        self._met: dict[str, tuple[float, float]] = {}

    def odds(self, word: str) -> tuple[float, float]:
        got = self._met.get(word)
        if got is None:
            if len(self._met) >= REMEMBERED_WORDS:
                self._met.clear()
            got = self._words.get(word, 0.0), max([self._stems.get(s, 0.0) for s in _stems(word)], default=0.0)
            self._met[word] = got
        return got

    def features(self, text: str) -> list[float]:
        found = _words(text)
        n = len(found)
        if not n:
            return [0.0] * 9
        hit = stem_hit = 0
        total = stem_total = most = stem_most = 0.0
        marks = set()
        for w, c in Counter(found).items():
            whole, stem = self.odds(w)
            if whole > 0:
                hit, total, most = hit + c, total + c * whole, max(most, whole)
            if stem > 0:
                stem_hit, stem_total, stem_most = stem_hit + c, stem_total + c * stem, max(stem_most, stem)
            if whole > 0 or stem > 0:
                marks.add(w)
        near = 0
        if marks:
            # places within reach of a second person
            reach = np.zeros(n + 2 * NEAR + 1, np.int64)
            people = np.flatnonzero([w in SECOND_PERSON for w in found])
            np.add.at(reach, people, 1)
            np.add.at(reach, people + 2 * NEAR + 1, -1)
            close = np.cumsum(reach)[NEAR : NEAR + n] > 0
            near = int((close & np.array([w in marks for w in found])).sum())
        values = (hit / n, math.log1p(hit), total / n, most, stem_hit / n, math.log1p(stem_hit), stem_total / n, stem_most)
        return [*values, near / n]


def _featured(rows: DataFrame, words: dict[str, float], stems: dict[str, float], carry: list[str]) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = Lexicons(words, stems)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            values = [shape(t) + lexicons.features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [pa.array(values, pa.list_(pa.float64()))], names=[*carry, "values"]
            )

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry]
    out = rows.mapInArrow(measure, ", ".join([*kinds, "values array<double>"]))
    return out.withColumn("features", array_to_vector("values")).drop("values")


def _lexicons(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that toxic documents have more often, with their log odds."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, bool, int]] = []
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                words = set(_words(text.as_py() or ""))
                out += [(w, False, label) for w in words]
                out += [(s, True, label) for s in {s for w in words for s in _stems(w)}]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            kinds = (pa.string(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["entry", "stem", "label"]
            )

    totals = rows.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    toxic, clean = (totals.toxic or 0) + 1.0, totals.n - (totals.toxic or 0) + 1.0
    counted = rows.mapInArrow(entries, "entry string, stem boolean, label int").groupBy("entry", "stem")
    counted = counted.agg(F.sum("label").alias("t"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    odds = F.log((F.col("t") + 0.5) / toxic) - F.log((F.col("n") - F.col("t") + 0.5) / clean)
    kept = counted.withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS)
    best = [
        kept.where(F.col("stem") == stem).orderBy(F.desc(F.col("odds") * F.log1p("t")), "entry").limit(MOST_ENTRIES).collect()
        for stem in (False, True)
    ]
    words, stems = ({r.entry: float(r.odds) for r in rows} for rows in best)
    return words, stems


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_labelled: int = MOST_LABELLED,
) -> ToxicityModel | None:
    """Fit on about ``most_labelled`` labelled documents that ``training`` (over ``doc_id``) admits.

    None if the part for the trees or for the calibration lacks one of the two labels.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # about most_labelled ids of 16 bytes
    ids = F.broadcast(labelled_ids(labels, label_col, training, most_labelled))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(21)), F.lit(20))
    rows = stored(texts.join(ids, "doc_id").withColumn("part", part.cast("int")), "toxic-rows")
    words, stems = _lexicons(rows.where("part < 9"))
    data = _featured(rows.where("part >= 9"), words, stems, ["doc_id", "label", "part"])
    # sorted into one partition: a bounded sample, and trees are the same in every run
    data = data.repartition(1).sortWithinPartitions("doc_id")
    data = stored(data.withColumn("label", F.col("label").cast("double")), "toxic-features").coalesce(1)
    fit, held = data.where("part < 16"), data.where("part >= 16")
    if min(d.select("label").distinct().count() for d in (fit, held)) < 2:
        return None
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=1, cacheNodeIds=False).fit(fit)
    chances = trees.transform(held).select("label", vector_to_array("probability")[1].alias("chance"))
    calibration = IsotonicRegression(featuresCol="chance", labelCol="label").fit(chances)
    return ToxicityModel(words, stems, trees, calibration)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns named by ``keep``, default all) and ``score``, the chance of toxicity.

    Whole texts are measured; a null text counts as empty. Without a model every score is 0.
    """
    kept = F.struct(*[F.col(c) for c in (docs.columns if keep is None else keep)]).alias("row")
    if model is None:
        return docs.select(kept, F.lit(0.0).alias("score"))
    rows = docs.select(kept, F.col(text_col).cast("string").alias("text"))
    data = _featured(rows, model.words, model.stems, ["row"])
    chances = model.trees.transform(data).select("row", vector_to_array("probability")[1].alias("chance"))
    scored = model.calibration.setFeaturesCol("chance").setPredictionCol("score").transform(chances)
    return scored.select("row", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
