"""Toxicity categories by a classifier chain.

Categories are predicted one after the other. Each link is a logistic regression on the
distinct words and word beginnings of a text and on the probabilities of all earlier categories;
in training those are out-of-fold predictions, so that a link learns how far the earlier ones can
be trusted. The last link is the labelled category ``toxic`` itself. The sample is bounded by
``TRAINING_ROWS`` (the first by hash of the id). Features have weight if their rows are positive
more often than chance explains among so many features, which is no fixed count of rows: a few
labels teach what nearly all positive rows share, many labels rarer features too. Every whole text
is scored.

Defined results: a null or empty text has no words, its probabilities are those of the offsets;
without labels, or with one class, a link gives the smoothed share; null labels are ignored;
repeated rows are scored one by one; columns named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField

from tidemark.llm.batches import annotate
from tidemark.llm.linear import DIMENSIONS, Matrix, fit_logistic, fold_of, sample_rows, sigmoid
from tidemark.llm.training import sparse_sample
from tidemark.llm.words import ALPHANUMERIC, Words, mix

TRAINING_ROWS = 8192
FOLDS = 3
PENALTY = 2e-5
BEGINNINGS = (5, 6, 7)  # bytes of a longer word
THRESHOLD = 0.5
#: Categories of a toxic document by the terms that it holds, in the order of the chain.
CATEGORY_TERMS = {
    "insult": ["clown", "idiot", "loser", "moron", "scum"],
    "contempt": ["disgusting", "pathetic", "stupid", "trash", "worthless"],
}


def word_features(texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all words and of the beginnings of longer ones, hashed. Words are runs
    of ASCII letters, digits and characters beyond ASCII, without regard to case."""
    words = Words(texts, ALPHANUMERIC)
    data, size = np.frombuffer(words.data, np.uint8), words.ends - words.starts
    owner, at = words.owner(), np.arange(len(size))
    owners, hashes = [owner], [words.hashes]
    begun = np.zeros(len(size), np.uint64)
    for length in range(1, max(BEGINNINGS) + 1):
        longer = size[at] > length
        at = at[longer]
        begun = mix(begun[longer] + ALPHANUMERIC.codes[data[words.starts[at] + length - 1]])
        if length in BEGINNINGS:
            owners.append(owner[at])
            hashes.append(begun)
    feature = (np.concatenate(hashes) % np.uint64(DIMENSIONS)).astype(np.int64)
    return np.concatenate(owners), feature


def present_features(texts, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the distinct features, only of ``known`` ones if given."""
    owner, feature = word_features(texts)
    if known is not None:
        keep = known[feature]
        owner, feature = owner[keep], feature[keep]
    return np.divmod(np.unique(owner * DIMENSIONS + feature), DIMENSIONS)


def presence_rows(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    owner, feature = present_features(texts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(feature[a:b], np.ones(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass
class Chain:
    """One row of ``weights`` per category over the hashed words; ``links[j]`` weighs the log
    odds of the categories before j."""

    categories: list[str]
    known: np.ndarray
    weights: np.ndarray
    links: list[np.ndarray]
    offsets: np.ndarray

    def probabilities(self, texts) -> np.ndarray:
        owner, feature = present_features(texts, self.known)
        odds = np.zeros((len(self.categories), len(texts)))
        chances = np.zeros_like(odds)
        for j, weights in enumerate(self.weights):
            odds[j] = np.bincount(owner, weights[feature], minlength=len(texts)) + self.offsets[j]
            odds[j] += self.links[j] @ chances[:j]
            chances[j] = sigmoid(odds[j])
        return chances


def joined(matrix: Matrix, extra: np.ndarray) -> Matrix:
    """``matrix`` with one dense column per row of ``extra`` at its end."""
    width, n = len(matrix.features), matrix.height
    rows = np.concatenate([matrix.rows, *(np.arange(n, dtype=np.int32) for _ in extra)])
    columns = np.concatenate(
        [matrix.columns, *(np.full(n, width + k, np.int32) for k in range(len(extra)))]
    )
    order = np.argsort(rows, kind="stable")
    values = np.concatenate([matrix.values, *extra])
    features = np.append(matrix.features, DIMENSIONS + np.arange(len(extra)))
    return Matrix(rows[order], columns[order], values[order], features, n)


def columns_of(matrix: Matrix, chosen: np.ndarray) -> Matrix:
    keep, number = chosen[matrix.columns], np.cumsum(chosen, dtype=np.int32) - 1
    return Matrix(
        matrix.rows[keep], number[matrix.columns[keep]], matrix.values[keep],
        matrix.features[chosen], matrix.height,
    )


def informative(matrix: Matrix, targets: np.ndarray) -> Matrix:
    """Only the columns that speak for some target: the log likelihood ratio of their positive
    rows against chance exceeds the logarithm of the number of columns, so that among all of them
    about one would get there by chance."""
    columns = len(matrix.features)
    size = np.bincount(matrix.columns, minlength=columns)
    chosen = np.zeros(columns, bool)
    for y in targets.T if columns else ():
        hits = np.bincount(matrix.columns, y[matrix.rows], minlength=columns)
        gain = hits * np.log(np.maximum(hits, 1e-9) / np.maximum(size * y.mean(), 1e-9))
        chosen |= gain > np.log(columns)
    return columns_of(matrix, chosen)


def fit_chain(matrix: Matrix, targets: np.ndarray, categories: list[str]) -> Chain:
    width, n = len(matrix.features), matrix.height
    part = fold_of(n, FOLDS)
    unseen = np.zeros((0, n))
    weights = np.zeros((len(categories), DIMENSIONS))
    links, offsets = [], np.zeros(len(categories))
    for j in range(len(categories)):
        rows, y = joined(matrix, unseen), targets[:, j]
        chance = np.zeros(n)
        for fold in range(FOLDS):
            w, b = fit_logistic(rows.take(part != fold), y[part != fold], PENALTY)
            chance[part == fold] = sigmoid(rows.take(part == fold).dot(w) + b)
        w, offsets[j] = fit_logistic(rows, y, PENALTY)
        weights[j, matrix.features] = w[:width]
        links.append(w[width:])
        unseen = np.vstack([unseen, chance])
    return Chain(categories, (weights != 0).any(axis=0), weights, links, offsets)


def category_targets(docs: DataFrame, labels: DataFrame, terms=CATEGORY_TERMS) -> DataFrame:
    """Per labelled id: ``toxic``, and per category whether it is toxic and holds a term."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    words = F.split(F.lower("text"), "[^a-z]+")
    held = docs.join(F.broadcast(marked.select("doc_id")), "doc_id").groupBy("doc_id").agg(
        *(
            F.max(F.arrays_overlap(words, F.array(*map(F.lit, listed)))).alias(name)
            for name, listed in terms.items()
        )
    )
    return marked.join(held, "doc_id").select(
        "doc_id",
        *(
            (F.coalesce(F.col(name), F.lit(False)) & (F.col("toxic") == 1)).cast("int").alias(name)
            for name in terms
        ),
        "toxic",
    )


def train_chain(
    docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, terms=CATEGORY_TERMS
) -> Chain:
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = category_targets(docs, sample_rows(usable, "doc_id", rows), terms)
    categories = [*terms, "toxic"]
    matrix, targets = sparse_sample(docs, chosen, categories, features=presence_rows)
    return fit_chain(informative(matrix, targets), targets, categories)


def toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep_text: bool = True
) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category and ``is_toxic``."""
    chain = train_chain(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def kernel():
        def judge(texts):
            chances = model.value.probabilities(texts)
            return [*chances, chances[-1] >= threshold]

        return judge

    fields = [StructField(f"p_{name}", DoubleType()) for name in chain.categories]
    return annotate(
        docs, kernel, [*fields, StructField("is_toxic", BooleanType())], keep_text=keep_text
    )
