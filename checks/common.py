"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, kpis, silver
from tidemark.plans import detection, medallion
from tidemark.sources import event_feed


def day(name: str) -> Column:
    """A date as ISO text, under its own name."""
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def stamp(name: str) -> Column:
    """A timestamp to the second as text, under its own name."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def with_days(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[day(c) if c in names else F.col(c) for c in df.columns])


def silver_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.to_silver(event_feed.bronze(spark, sf_dir))


def daily_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.daily_kpi(silver_of(spark, sf_dir))


def gold_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.gold_from_bronze(event_feed.bronze(spark, sf_dir))


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.features_from_bronze(event_feed.bronze(spark, sf_dir))


def live_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live KPIs of the deduped events, in batch."""
    events = silver_of(spark, sf_dir).withColumn("amount", F.col("amount_cents").cast("string"))
    return kpis.live_kpis(kpis.live_daily(events))


def scored_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.zscore_scores(features_of(spark, sf_dir))


def rule_records_of(spark: SparkSession, sf_dir: str, threshold: float = 0.95) -> DataFrame:
    return detection.rule_records(scored_of(spark, sf_dir), threshold)


def standardised_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.standardise(features_of(spark, sf_dir))
