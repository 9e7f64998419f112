"""Scores per tenant-day, the rank-blended ensemble, and typed anomaly records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import (
    attribution,
    classify,
    evaluate,
    features,
    forest,
    ordering,
    splits,
    temporal,
)
from tidemark.schemas import METRICS, SCORE_THRESHOLD
from tidemark.session import cut_lineage

KEY = ["tenant_id", "metric_date"]
Z_COLUMNS = [f"z_{m}" for m in METRICS]


def blend(temporal_rank: Column, forest_rank: Column, weight: float = 0.5) -> Column:
    return F.lit(weight) * temporal_rank + F.lit(1.0 - weight) * forest_rank


def with_forest(frame: DataFrame, trees: int = 200, seed: int = 0) -> DataFrame:
    """Adds ``forest``: isolation score on the standardised metrics."""
    grown = forest.fit(frame, Z_COLUMNS, KEY, trees=trees, seed=seed)
    return forest.score(frame, grown)


def ensemble(
    feature_frame: DataFrame,
    window: int = 7,
    weight: float = 0.5,
    trees: int = 200,
    seed: int = 0,
) -> DataFrame:
    """Adds ``temporal``, ``forest`` and the blended ``score`` in [0, 1]. Runs its jobs.

    The standardised frame is written once to the checkpoint folder: five later passes read
    it (fitting, sampling, scoring and the two rankings).
    """
    standardised = cut_lineage(features.standardise(feature_frame))
    grown = forest.fit(standardised, Z_COLUMNS, KEY, trees=trees, seed=seed)
    scored = forest.score(temporal.temporal_scores(standardised, window), grown)
    by_time = ordering.rank_percentile(scored, "temporal", KEY, "temporal_rank")
    by_point = ordering.rank_percentile(by_time, "forest", KEY, "forest_rank")
    return by_point.withColumn("score", blend(F.col("temporal_rank"), F.col("forest_rank"), weight))


def zscore_scores(feature_frame: DataFrame, window: int = 7) -> DataFrame:
    """The model-free score: rank percentile of the rolling z-score. Runs one job."""
    scored = features.rolling_zscore(feature_frame, window)
    rounded = scored.withColumn("zscore", F.round("zscore", 9))
    return ordering.rank_percentile(rounded, "zscore", KEY, "score")


def anomaly_records(
    scored: DataFrame,
    classifier: classify.TypeClassifier,
    threshold: float = SCORE_THRESHOLD,
) -> DataFrame:
    """Flagged days as records: attributed, described, classified, highest score first."""
    flagged = attribution.flagged_records(scored, threshold)
    typed = classify.classify(flagged, classifier, "description")
    return (
        typed.withColumnRenamed("prediction", "anomaly_type")
        .withColumnRenamed("confidence", "type_confidence")
        .orderBy(F.desc("anomaly_score"), "tenant_id", "metric_date")
    )


def rank_scores(
    feature_frame: DataFrame, windows: list[int], trees: int = 200, seed: int = 0
) -> DataFrame:
    """Adds ``forest_rank`` and ``temporal_rank_<w>`` per window size. Runs its jobs."""
    rows = cut_lineage(features.standardise(feature_frame))
    rows = ordering.rank_percentile(with_forest(rows, trees, seed), "forest", KEY, "forest_rank")
    for window in windows:
        scored = temporal.temporal_scores(rows, window)
        rows = ordering.rank_percentile(
            scored, "temporal", KEY, f"temporal_rank_{window}"
        ).drop("temporal")
    return rows


def tune_and_benchmark(
    labelled_features: DataFrame,
    windows: list[int],
    weights: list[float],
    holdout: float = 0.33,
    trees: int = 200,
    seed: int = 0,
) -> DataFrame:
    """Chooses window and blend weight by average precision on the tuning tenants, then
    compares all detectors on the held-out tenants. Runs its jobs.

    Rows are features with ``label`` and ``regime``; no held-out tenant is seen in tuning.
    """
    held = splits.held_out_tenants(labelled_features, fraction=holdout, seed=seed)
    tuning, final = splits.hold_out(labelled_features, cut_lineage(held), "tenant_id")
    ranks = rank_scores(tuning, windows, trees, seed)
    sweep = evaluate.weight_sweep(
        ranks, {w: f"temporal_rank_{w}" for w in windows}, "forest_rank", weights
    )
    best = evaluate.best_trial(sweep).first()  # one row
    scored = ensemble(final, best["window"], best["weight"], trees, seed)
    scored = features.ar2_residual(features.rolling_zscore(scored))
    methods = {"ensemble": "score", "forest": "forest", "zscore": "zscore", "ar2": "ar2"}
    long = evaluate.long_scores(scored, methods, [*KEY, "label", "regime"])
    return evaluate.benchmark(long, ["method"]).select(
        "*", F.lit(best["window"]).alias("window"), F.lit(best["weight"]).alias("weight")
    )


def driver_rule(driver: Column) -> Column:
    """Incident type a leading driver usually stands for.

    Stands in for labelled incident text where none is supplied: used to label training
    descriptions, never to override a classifier.
    """
    metric, rising = driver["metric"], driver["sd"] > 0
    return (
        F.when(metric == "refund_rate", "payment_failure")
        .when((metric == "mrr") & rising, "pricing_effect")
        .when(metric == "mrr", "churn_spike")
        .when((metric == "checkout_volume") & rising, "seasonal_dip")
        .when(metric == "checkout_volume", "acquisition_drop")
        .otherwise("infrastructure_issue")
    )


def training_text(feature_frame: DataFrame) -> DataFrame:
    """Descriptions of all tenant-days with the type their leading driver stands for."""
    return attribution.described_days(feature_frame).select(
        "tenant_id", "metric_date", "text", driver_rule(F.col("driver")).alias("label")
    )


def rule_records(scored: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Records typed by the driver rule instead of a model; the share of the leading
    deviation among the top contributors serves as confidence."""
    flagged = attribution.flagged_records(scored, threshold)
    size = F.aggregate(
        "top_contributors", F.lit(0.0), lambda total, c: total + F.abs(c["sd"])
    )
    lead = F.abs(F.element_at("top_contributors", 1)["sd"])
    return flagged.withColumn(
        "anomaly_type", driver_rule(F.element_at("top_contributors", 1))
    ).withColumn(
        "type_confidence",
        F.round(F.coalesce(F.try_divide(lead, size), F.lit(0.0)), 4),
    )
