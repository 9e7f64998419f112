"""Faithfulness of an explanation: which of its numbers appear in its sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import numbers
from tidemark.schemas import FAITHFULNESS_THRESHOLD, METRICS, REVIEW_CONFIDENCE


def _matches(value: Column, source: Column) -> Column:
    gap = F.abs(value - source)
    return (gap < 1e-6) | ((source != 0) & (F.try_divide(gap, F.abs(source)) < 1e-3))


def faithfulness(explanation: Column, sources: Column) -> Column:
    """Share of the explanation's numbers found in the source numbers; 1 without numbers."""
    stated = numbers(explanation)
    grounded = F.filter(stated, lambda n: F.exists(sources, lambda s: _matches(n, s)))
    return F.when(F.size(stated) == 0, F.lit(1.0)).otherwise(
        F.size(grounded).cast("double") / F.size(stated)
    )


def record_numbers() -> Column:
    """Numbers of a record: its typed fields, plus those written in its id, date and text."""
    typed = F.array(
        F.col("anomaly_score"),
        F.col("type_confidence"),
        *[F.element_at("metrics", F.lit(m)) for m in METRICS],
    )
    drivers = F.transform("top_contributors", lambda c: c["sd"])
    written = F.flatten(
        F.array(
            numbers(F.col("tenant_id")),
            numbers(F.col("metric_date")),
            numbers(F.col("anomaly_type")),
            numbers(F.col("description")),
        )
    )
    return F.filter(F.concat(typed, drivers, written), lambda x: x.isNotNull())


def context_numbers(documents: Column) -> Column:
    """Numbers of the retrieved documents, which carry those of their whole text."""
    return F.array_distinct(F.flatten(F.transform(documents, lambda d: d["numbers"])))


def is_faithful(score: Column, threshold: float = FAITHFULNESS_THRESHOLD) -> Column:
    return score >= threshold


def alert_status(confidence: Column, faithful: Column) -> Column:
    """Low type confidence is held for review first, ungrounded text second."""
    return (
        F.when(confidence < REVIEW_CONFIDENCE, "held_for_review")
        .when(~F.coalesce(faithful, F.lit(False)), "held_low_faithfulness")
        .otherwise("ready")
    )
