"""Bronze → silver → gold, and the gated run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import features, kpis, quality, silver
from tidemark.session import working_path
from tidemark.sources import published, sinks, tables


def gold_from_bronze(bronze: DataFrame) -> DataFrame:
    return kpis.gold(kpis.daily_kpi(silver.to_silver(bronze)))


def features_from_bronze(bronze: DataFrame) -> DataFrame:
    return features.day_index(features.adapt(gold_from_bronze(bronze)))


def gate_report(bronze: DataFrame, silver_rows: DataFrame, gold: DataFrame) -> DataFrame:
    return (
        quality.report(bronze, "bronze", quality.bronze_checks(bronze))
        .unionByName(quality.report(silver_rows, "silver", quality.silver_checks(silver_rows)))
        .unionByName(quality.report(gold, "gold", quality.gold_checks(gold)))
    )


def gated_run(bronze: DataFrame, gold_path: str, enforce: bool = True) -> DataFrame:
    """Gates bronze, silver and a new gold, then publishes that; returns the summary.

    Gold is written as a new version of the published table, which readers see once it has
    passed. With ``enforce`` a breach raises; then, or if the run dies at any point, what was
    published before stays as it was.
    """
    spark = bronze.sparkSession
    summary = []
    published.publish(spark, gold_path, lambda folder: summary.append(_gated(bronze, folder, enforce)))
    return summary[0]


def _gated(bronze: DataFrame, folder: str, enforce: bool) -> DataFrame:
    spark = bronze.sparkSession
    staged = working_path(spark, "gated-run")
    silver.to_silver(bronze).write.parquet(f"{staged}/silver")
    typed = spark.read.parquet(f"{staged}/silver")
    sinks.write_gold(kpis.gold(kpis.daily_kpi(typed)), folder)
    made = tables.read_gold(spark, folder)
    summary = quality.suite_summary(gate_report(bronze, typed, made))
    if enforce:
        quality.enforce(summary)
    return summary
