"""Quality rules: fixed text rules, then a calibrated n-gram logistic regression.

The model is trained on at most ``TRAINING_ROWS`` labelled documents (the first by hash of
their id), calibrated on out-of-fold scores and applied to Arrow batches of all texts; a
document is kept if it breaks no rule and its probability reaches a fixed threshold.

Defined results: a null or empty text has no words and fails the rules; without labels, or
with labels of one class, the probability is their smoothed share; repeated rows and ids are
judged one by one; a null id is passed through; labels that are null are ignored; columns
named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from tidemark.llm.batches import annotate
from tidemark.llm.linear import (
    DIMENSIONS,
    calibrate,
    fit_logistic,
    fold_of,
    sample_rows,
    score_texts,
    sigmoid,
)
from tidemark.llm.training import sparse_sample
from tidemark.llm.words import Words, sequence_hashes

TRAINING_ROWS = 4096
FOLDS = 3
PENALTY = 1e-5
#: Fixed thresholds.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
MIN_PROBABILITY = 0.4
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"

RULE_FIELDS = [
    *(
        StructField(name, LongType())
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ),
    StructField("base_failed", BooleanType()),
]


@dataclass
class QualityModel:
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def probabilities(self, texts) -> np.ndarray:
        z = score_texts(texts, self.weights, self.offset)
        return sigmoid(self.slope * z + self.shift)


def repeated_words(found: Words, size: int) -> np.ndarray:
    """Per text: words inside windows of ``size`` words that the text holds at least twice."""
    text, start = found.windows(size)
    covered = np.zeros(len(found.hashes) + 1, np.int64)
    if len(start):
        key = sequence_hashes(found.hashes, start, size)
        order = np.lexsort((key, text))
        key, owner, start = key[order], text[order], start[order]
        same = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
        twice = np.append(same, False) | np.append(False, same)
        np.add.at(covered, start[twice], 1)
        np.add.at(covered, start[twice] + size, -1)
    inside = (np.cumsum(covered)[:-1] > 0).astype(np.int64)
    return np.bincount(found.owner(), inside, len(found.counts)).astype(np.int64)


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    for line in lines:
        seen.add(line)
    return len(lines) - len(seen)


def rule_columns(texts) -> list[list]:
    full = [t or "" for t in texts]
    found = Words(texts)
    words = found.counts
    repeated = repeated_words(found, REPEAT_WINDOW)
    return [
        words.tolist(),
        [len(t) - sum(map(t.count, _SPACES)) for t in full],
        [sum(map(t.count, SYMBOLS)) for t in full],
        [repeated_lines(t) for t in full],
        repeated.tolist(),
        ((words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)).tolist(),
    ]


def train_quality(
    docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, label: str = "quality"
) -> QualityModel:
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max(label).alias("target"))
    matrix, targets = sparse_sample(docs, sample_rows(usable, "doc_id", rows), ["target"])
    y = targets[:, 0]
    part = fold_of(len(y), FOLDS)
    unseen = np.zeros(len(y))
    for fold in range(FOLDS):
        weights, offset = fit_logistic(matrix.take(part != fold), y[part != fold], PENALTY)
        unseen[part == fold] = matrix.take(part == fold).dot(weights) + offset
    slope, shift = calibrate(unseen, y)
    weights, offset = fit_logistic(matrix, y, PENALTY)
    dense = np.zeros(DIMENSIONS)
    dense[matrix.features] = weights
    return QualityModel(dense, offset, slope, shift)


def quality_rules(
    docs: DataFrame, labels: DataFrame, min_probability=MIN_PROBABILITY, keep_text: bool = True
) -> DataFrame:
    """``docs`` with the rule columns, ``probability`` and ``kept``."""
    model = docs.sparkSession.sparkContext.broadcast(train_quality(docs, labels))

    def kernel():
        def judge(texts):
            rules = rule_columns(texts)
            probability = model.value.probabilities(texts)
            kept = (probability >= min_probability) & ~np.array(rules[-1], bool)
            return [*rules, probability, kept]

        return judge

    fields = [
        *RULE_FIELDS, StructField("probability", DoubleType()), StructField("kept", BooleanType())
    ]
    return annotate(docs, kernel, fields, keep_text=keep_text)
