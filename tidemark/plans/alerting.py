"""The alert job: stored KPIs → detection → explanation → alert log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import classify, features
from tidemark.plans import detection, explain
from tidemark.session import cut_lineage
from tidemark.sources import sinks, tables

KEY = ["tenant_id", "metric_date", "anomaly_type"]
#: Defaults of the job.
THRESHOLD = 0.9
TOP_K = 6


def model_records(frame: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Records of the ensemble, typed by a classifier fitted on all described days."""
    classifier = classify.fit(detection.training_text(frame))
    return detection.anomaly_records(detection.ensemble(frame), classifier, threshold)


def log_alerts(
    spark: SparkSession,
    gold_path: str,
    docs: DataFrame,
    log_path: str,
    run_id: int,
    detect: Callable[[DataFrame], DataFrame] = model_records,
    top_k: int = TOP_K,
    base_k: int = 3,
    detected_at: Column | None = None,
) -> None:
    """Explains the ``top_k`` highest-scored records and upserts them, every column of a known
    key refreshed. Writing a run again replaces its rows. Without records nothing is written.
    """
    frame = features.day_index(features.adapt(tables.read_gold(spark, gold_path)))
    order = [F.desc("anomaly_score"), "tenant_id", "metric_date"]
    leading = cut_lineage(detect(frame).orderBy(*order).limit(top_k))
    if leading.isEmpty():
        return
    at = F.current_timestamp() if detected_at is None else detected_at
    alerts = explain.explained_alerts(leading, docs, base_k).drop("retried", "text")
    sinks.upsert_batch(alerts.withColumn("detected_at", at), log_path, run_id, "metric_date")


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return sinks.read_upserted(spark, log_path, KEY)
