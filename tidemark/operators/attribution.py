"""Which metrics drove a flagged day, and what its text and fields say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import exact_round
from tidemark.functions.text import describe
from tidemark.operators.features import with_baseline
from tidemark.schemas import METRICS, SCORE_THRESHOLD


def deviations(metrics: list[str] = METRICS) -> Column:
    """Signed deviation of each metric in sample deviations, largest first."""
    entries = []
    for place, m in enumerate(metrics):
        std = F.col(f"{m}_std")
        usable = F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std)
        sd = (F.col(m) - F.col(f"{m}_mean")) / usable
        entries.append(
            F.struct(
                (-F.round(F.abs(sd), 9)).alias("size"),
                F.lit(place).alias("place"),
                F.lit(m).alias("metric"),
                sd.alias("sd"),
            )
        )
    return F.transform(
        F.array_sort(F.array(*entries)),
        lambda e: F.struct(e["metric"].alias("metric"), e["sd"].alias("sd")),
    )


def _leading(top_k: int = 3) -> Column:
    """The first ``top_k`` of ``_deviations``, to two places."""
    return F.transform(
        F.slice("_deviations", 1, top_k),
        lambda c: F.struct(c["metric"].alias("metric"), exact_round(c["sd"], 2).alias("sd")),
    )


def top_contributors(rows: DataFrame, top_k: int = 3) -> DataFrame:
    """Adds ``top_contributors`` from rows that carry their tenant's baseline."""
    return (
        rows.withColumn("_deviations", deviations())
        .withColumn("top_contributors", _leading(top_k))
        .drop("_deviations")
    )


def above(rows: DataFrame, threshold: float = SCORE_THRESHOLD, score: str = "score") -> DataFrame:
    return rows.where(F.col(score) >= threshold)


def _metric_map(places: int) -> Column:
    pairs = [x for m in METRICS for x in (F.lit(m), exact_round(F.col(m), places))]
    return F.create_map(*pairs)


def flagged_records(scored: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Scored days at or above the threshold, attributed and described.

    The baseline covers all of a tenant's days, so it is taken before the threshold; the
    array work is done on the flagged rows alone.
    """
    flagged = above(with_baseline(scored), threshold).withColumn("_deviations", deviations())
    return flagged.select(
        "tenant_id",
        F.col("metric_date").cast("string").alias("metric_date"),
        F.col("score").alias("anomaly_score"),
        _leading().alias("top_contributors"),
        describe(F.col("_deviations")).alias("description"),
        _metric_map(4).alias("metrics"),
    )


def described_days(frame: DataFrame) -> DataFrame:
    """Every tenant-day with its description and leading contributor: classifier text."""
    attributed = with_baseline(frame).withColumn("_deviations", deviations())
    return attributed.select(
        "tenant_id",
        "metric_date",
        F.col("_deviations")[0].alias("driver"),
        describe(F.col("_deviations")).alias("text"),
    )
