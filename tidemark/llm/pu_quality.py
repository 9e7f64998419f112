"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good, the unlabelled text is a sample of all documents.
The class prior is estimated first, as the smallest upper bound of U(score >= c) / P(score >= c)
over the scores of a positive-against-unlabelled model on rows it was not fitted on. Then a
linear model on hashed n-grams minimises the non-negative risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

in small batches: where the bracket is negative, the step goes back on it. Only the positive
label is used, never a negative one. Samples are bounded by ``POSITIVE_ROWS`` and
``UNLABELLED_ROWS`` (the first by hash of the id); every text is scored.

Defined results: a null text scores as an empty one; without trusted positives or unlabelled
rows the prior, and so every score, is a half; repeated rows are scored one by one; columns
named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from tidemark.llm.batches import annotate
from tidemark.llm.linear import (
    DIMENSIONS,
    Matrix,
    fit_logistic,
    fold_of,
    sample_rows,
    score_texts,
    sigmoid,
)
from tidemark.llm.training import sparse_sample

POSITIVE_ROWS = 2000
UNLABELLED_ROWS = 3500
EPOCHS = 40
BATCHES = 10
RATE = 0.05
PENALTY = 1e-5


@dataclass
class PuModel:
    weights: np.ndarray
    offset: float
    prior: float

    def scores(self, texts) -> np.ndarray:
        return sigmoid(score_texts(texts, self.weights, self.offset))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, risk: float = 0.1) -> float:
    """Share of positives among the unlabelled from two samples of scores.

    Each tail share is taken with its deviation bound, so that small tails don't win.
    """
    n, m = len(positive), len(unlabelled)
    if not n or not m:
        return 0.5
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / n
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / m
    slack = np.sqrt(np.log(4 / risk) / (2 * n)) + np.sqrt(np.log(4 / risk) / (2 * m))
    usable = p > slack
    best = np.argmin((u[usable] + slack) / p[usable])
    return float(np.clip(u[usable][best] / p[usable][best], 0.01, 0.99))


def fit_non_negative(
    matrix: Matrix, positive: np.ndarray, prior: float
) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; rows come in hash order, so slices are random batches."""
    p, u = matrix.take(positive), matrix.take(~positive)
    x = np.zeros(len(matrix.features) + 1)
    first, second = np.zeros_like(x), np.zeros_like(x)
    cut_p = np.linspace(0, p.height, BATCHES + 1).astype(int)
    cut_u = np.linspace(0, u.height, BATCHES + 1).astype(int)
    step = 0
    for _ in range(EPOCHS):
        for k in range(BATCHES):
            a, b = p.between(cut_p[k], cut_p[k + 1]), u.between(cut_u[k], cut_u[k + 1])
            if not a.height or not b.height:
                continue
            zp, zu = a.dot(x[:-1]) + x[-1], b.dot(x[:-1]) + x[-1]
            bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            as_negative = -prior * sigmoid(zp) / a.height, sigmoid(zu) / b.height
            if bracket >= 0:
                rp = -prior * sigmoid(-zp) / a.height + as_negative[0]
                ru = as_negative[1]
            else:
                rp, ru = -as_negative[0], -as_negative[1]
            slope = np.append(a.back(rp) + b.back(ru) + PENALTY * x[:-1], rp.sum() + ru.sum())
            step += 1
            first += 0.1 * (slope - first)
            second += 0.001 * (slope**2 - second)
            x -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return x[:-1], float(x[-1])


def train_pu(
    docs: DataFrame, trusted: DataFrame, positives=POSITIVE_ROWS, unlabelled=UNLABELLED_ROWS
) -> PuModel:
    """``trusted``: doc_id of documents known to be good; ``docs``: the web text."""
    ids = lambda rows: rows.where("doc_id IS NOT NULL").select("doc_id").distinct()
    samples = [
        sample_rows(ids(rows), "doc_id", bound).withColumn("positive", F.lit(mark))
        for rows, bound, mark in ((trusted, positives, 1), (docs, unlabelled, 0))
    ]
    matrix, targets = sparse_sample(docs, samples[0].unionByName(samples[1]), ["positive"])
    positive = targets[:, 0] == 1
    dense = np.zeros(DIMENSIONS)
    if not positive.any() or positive.all():
        return PuModel(dense, 0.0, 0.5)
    part = fold_of(len(positive), 2)
    seen = np.zeros(len(positive))
    for fold in range(2):
        weights, offset = fit_logistic(matrix.take(part != fold), positive[part != fold], 1e-4, 25)
        seen[part == fold] = matrix.take(part == fold).dot(weights) + offset
    prior = estimate_prior(seen[positive], seen[~positive])
    weights, offset = fit_non_negative(matrix, positive, prior)
    dense[matrix.features] = weights
    return PuModel(dense, offset, prior)


def pu_quality(
    docs: DataFrame, trusted: DataFrame, web: DataFrame, keep_text: bool = True
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from a half on)."""
    model = docs.sparkSession.sparkContext.broadcast(train_pu(web, trusted))

    def kernel():
        def judge(texts):
            score = model.value.scores(texts)
            return [score, (score >= 0.5).astype(np.int32)]

        return judge

    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return annotate(docs, kernel, fields, keep_text=keep_text)
