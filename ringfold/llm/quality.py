"""Quality classifier by positive-unlabelled learning.

Only trusted positives and unlabelled text are learnt from. The share of positives among
the unlabelled is estimated first; then a small network minimises the unbiased risk of
positive-unlabelled learning, in which the part for negatives is kept from falling below
zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringfold.llm.features import shape
from ringfold.llm.samples import drawn, labelled_ids, shape_rows

#: Rows that are learnt from: trusted positives, and unlabelled texts.
MOST_POSITIVES = 6_000
MOST_UNLABELLED = 9_000
_HIDDEN = 24
_STEPS = 1500
_BATCH = 512
_RATE = 0.01
_DECAY = 1e-4


class Network(NamedTuple):
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 5) -> Network:
    """Fit on features of positives and unlabelled rows, both weighing the same.

    With a ``prior``: the non-negative risk
    ``prior R_p(+) + max(0, R_u(-) - prior R_p(-))`` under the logistic loss; a step in
    which the second term is negative goes the other way on that term alone. Without:
    positives against unlabelled, as the estimate of the prior needs.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    d = both.shape[1]
    params = [rng.normal(0, (2 / d) ** 0.5, (d, _HIDDEN)), np.zeros(_HIDDEN), rng.normal(0, 0.2, _HIDDEN), np.zeros(1)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, _STEPS + 1):
        p = positive[rng.integers(0, len(positive), _BATCH)]
        u = unlabelled[rng.integers(0, len(unlabelled), _BATCH)]
        z = np.clip((np.concatenate([p, u]) - mean) / scale, -8, 8)
        hidden = np.maximum(z @ params[0] + params[1], 0)
        margin = hidden @ params[2] + params[3][0]
        s = _sigmoid(margin)
        pull = np.zeros(2 * _BATCH)  # derivative of the risk by the margin
        if prior is None:
            pull[:_BATCH] = (s[:_BATCH] - 1) / _BATCH
            pull[_BATCH:] = s[_BATCH:] / _BATCH
        else:
            minus = np.logaddexp(0, margin)
            negative_risk = minus[_BATCH:].mean() - prior * minus[:_BATCH].mean()
            way = 1.0 if negative_risk >= 0 else -1.0
            pull[_BATCH:] = way * s[_BATCH:] / _BATCH
            pull[:_BATCH] = -way * prior * s[:_BATCH] / _BATCH
            if negative_risk >= 0:
                pull[:_BATCH] += prior * (s[:_BATCH] - 1) / _BATCH
        back = np.outer(pull, params[2]) * (hidden > 0)
        grads = [
            z.T @ back + _DECAY * params[0],
            back.sum(0),
            hidden.T @ pull + _DECAY * params[2],
            np.array([pull.sum()]),
        ]
        rate = _RATE * (1 - step / (_STEPS + 1))
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, *params)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> float:
    """Share of positives among the unlabelled rows.

    A network tells half of both apart. On the other half, unlabelled rows with the scores
    that positives have are nearly all positive: the ratio of the shares above a threshold
    bounds the prior, and the threshold with the least upper confidence bound is taken.
    Fewer than four rows of a kind say nothing: 0.5.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    rng = np.random.default_rng(seed)
    p, u = rng.permutation(positive), rng.permutation(unlabelled)
    net = fit_network(p[::2], u[::2], None, seed)
    sp, su = np.sort(net.margin(p[1::2])), np.sort(net.margin(u[1::2]))
    cuts = np.quantile(sp, np.linspace(0, 0.95, 96))
    above_p = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    above_u = 1 - np.searchsorted(su, cuts, "left") / len(su)
    slack = np.sqrt(np.log(20) / (2 * len(su))) + np.sqrt(np.log(20) / (2 * len(sp)))
    ratio = above_u / above_p
    best = int(np.argmin(ratio + slack * (1 + ratio) / above_p))
    return float(np.clip(ratio[best], 0.02, 0.98))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_positives: int = MOST_POSITIVES,
    most_unlabelled: int = MOST_UNLABELLED,
) -> Network | None:
    """Fit on bounded samples of the rows that ``training`` (over ``doc_id``) admits.

    Positives are documents with label 1, unlabelled rows any documents, their labels
    unseen. None if either sample is empty.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    admitted = texts.where(F.col("doc_id").isNotNull() & training)
    positives = labels.where(F.col(label_col) == 1)
    # about most_positives ids of 16 bytes
    ids = F.broadcast(labelled_ids(positives, label_col, training, most_positives))
    unlabelled = admitted.where(drawn(F.col("doc_id"), most_unlabelled / max(1, admitted.select("doc_id").count()), 12))
    rows = [
        [r.features for r in sorted(shape_rows(part, ["doc_id"]).collect(), key=lambda r: (r.doc_id, r.features))]
        for part in (admitted.join(ids, "doc_id"), unlabelled)
    ]
    if not all(rows):
        return None
    p, u = map(np.array, rows)
    return fit_network(p, u, estimate_prior(p, u))


def score_quality(docs: DataFrame, network: Network | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns named by ``keep``, default all) and ``score``, 0 to 1.

    Whole texts are measured; a null text counts as empty. Without a network every score
    is 0.5, so that nothing is rejected.
    """
    kept = F.struct(*[F.col(c) for c in (docs.columns if keep is None else keep)]).alias("row")
    rows = docs.select(kept, F.col(text_col).cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if network is None or not batch.num_rows:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = network.score(np.array([shape(t.as_py() or "") for t in batch.column(1)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["row", "score"])

    return rows.mapInArrow(score, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
