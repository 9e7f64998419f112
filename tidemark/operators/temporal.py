"""Temporal model: how badly a low-rank model rebuilds the window that ends on a day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import sliding_windows, warmup_backfill


@dataclass(frozen=True)
class Reconstruction:
    """Mean window and principal directions: (window × metrics) numbers squared at most."""

    model: PCAModel
    mean: list[float]
    width: int


def fit(windows: DataFrame, components: int = 8) -> Reconstruction | None:
    """Principal directions over all tenants' windows; None when there is no window.

    The covariance is a tree-aggregated (width × width) matrix.
    """
    vectors = windows.where("window_values is not null").select(
        array_to_vector("window_values").alias("v")
    )
    head = vectors.limit(2).collect()
    if len(head) < 2:
        return None
    width = len(head[0]["v"])
    mean = vectors.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray().tolist()
    model = PCA(k=min(components, width), inputCol="v", outputCol="p").fit(vectors)
    return Reconstruction(model, mean, width)


def _squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x)


def _minus(values: Column, constants: list[float]) -> Column:
    return F.zip_with(values, F.array(*[F.lit(float(c)) for c in constants]), lambda a, b: a - b)


def reconstruction_error(windows: DataFrame, fitted: Reconstruction | None) -> DataFrame:
    """Adds ``temporal``: mean squared residual outside the principal directions.

    |x − µ|² − |P'(x − µ)|², over the window width; NULL where there is no full window.
    """
    if fitted is None:
        return windows.drop("window_values").withColumn("temporal", F.lit(None).cast("double"))
    projected_mean = (fitted.model.pc.toArray().T @ fitted.mean).tolist()
    keep = [c for c in windows.columns if c != "window_values"]
    filled = F.coalesce("window_values", F.array_repeat(F.lit(0.0), fitted.width))
    scored = fitted.model.transform(windows.withColumn("v", array_to_vector(filled)))
    outside = _squares(_minus(F.col("window_values"), fitted.mean)) - _squares(
        _minus(vector_to_array("p"), projected_mean)
    )
    return scored.select(
        *keep,
        F.when(
            F.col("window_values").isNotNull(),
            F.greatest(outside, F.lit(0.0)) / F.lit(float(fitted.width)),
        ).alias("temporal"),
    )


def temporal_scores(
    standardised: DataFrame, window: int = 7, components: int = 8
) -> DataFrame:
    """Windows → fitted model → error per day, with the warm-up days filled. Runs three jobs."""
    windows = sliding_windows(standardised, window)
    return warmup_backfill(reconstruction_error(windows, fit(windows, components)), "temporal")
