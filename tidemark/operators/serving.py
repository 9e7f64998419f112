"""Serving queries over alerts, KPIs and the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import LATENCY_BOUNDS


def top_anomalies(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """Highest scores first; a distributed top-k, never a full sort."""
    return alerts.orderBy(F.desc("anomaly_score"), "tenant_id", "metric_date").limit(limit)


def kpi_history(kpis: DataFrame, tenant: str, days: int = 90) -> DataFrame:
    """The last days of one tenant, oldest first."""
    recent = kpis.where(F.col("tenant_id") == tenant).orderBy(F.desc("metric_date")).limit(days)
    return recent.orderBy("metric_date")


def kpi_history_all(kpis: DataFrame, days: int = 90) -> DataFrame:
    """The last days of every tenant, oldest first within the tenant."""
    latest = Window.partitionBy("tenant_id").orderBy(F.desc("metric_date"))
    return (
        kpis.withColumn("_r", F.row_number().over(latest))
        .where(F.col("_r") <= days)
        .drop("_r")
        .orderBy("tenant_id", "metric_date")
    )


def tenant_list(tenants: DataFrame) -> DataFrame:
    return tenants.select("tenant_id", "name").orderBy("tenant_id")


def stat_tiles(alerts: DataFrame) -> DataFrame:
    """Totals by status, mean faithfulness (0 if there is no alert) and distinct tenants."""
    ready = F.count_if(F.col("status").isin("ready", "sent"))
    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        ready.alias("ready"),
        (F.count(F.lit(1)) - ready).alias("held"),
        F.coalesce(F.avg("faithfulness"), F.lit(0.0)).alias("avg_faithfulness"),
        F.countDistinct("tenant_id").alias("tenants"),
    )


def driver_trend(alerts: DataFrame, kpis: DataFrame) -> DataFrame:
    """For each alert, its tenant's series of the alert's first driver; missing values are 0."""
    metrics = ["mrr", "conversion_rate", "refund_rate", "checkout_volume"]
    driver = F.coalesce(F.try_element_at("top_contributors", F.lit(1))["metric"], F.lit("mrr"))
    picked = alerts.select(
        "tenant_id", F.col("metric_date").alias("anomaly_date"), driver.alias("driver")
    )
    series = kpis.select(
        "tenant_id",
        "metric_date",
        F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))]).alias("values"),
    )
    return picked.join(series, "tenant_id").select(
        "tenant_id",
        "anomaly_date",
        "driver",
        "metric_date",
        F.coalesce(F.try_element_at("values", F.col("driver")), F.lit(0.0)).alias("value"),
    )


def _per(width: str) -> Column:
    return F.window("ts", width)["start"].alias("window_start")


def request_rate(log: DataFrame) -> DataFrame:
    """Requests per second by route over one-minute windows."""
    return log.groupBy(_per("1 minute"), "route").agg(
        (F.count(F.lit(1)) / F.lit(60.0)).alias("per_second")
    )


def error_rate(log: DataFrame) -> DataFrame:
    """Server errors per second over five-minute windows."""
    return log.groupBy(_per("5 minutes")).agg(
        (F.count_if(F.col("status").like("5%")) / F.lit(300.0)).alias("per_second")
    )


def hit_ratio(lookups: DataFrame) -> DataFrame:
    """Cache hits over lookups (at least 1) per five-minute window."""
    return lookups.groupBy(_per("5 minutes")).agg(
        (F.count_if("hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("ratio")
    )


def source_throughput(published: DataFrame) -> DataFrame:
    """Events per second by source over one-minute windows."""
    return published.groupBy(_per("1 minute"), "source").agg(
        (F.count(F.lit(1)) / F.lit(60.0)).alias("per_second")
    )


def latency_quantiles(
    log: DataFrame,
    quantiles: tuple[float, ...] = (0.5, 0.95, 0.99),
    bounds: list[float] = LATENCY_BOUNDS,
) -> DataFrame:
    """Quantiles per five-minute window from fixed cumulative buckets.

    Linear inside the bucket that reaches the rank, from 0 in the first; beyond the last
    bound the last bound is reported.
    """
    counts = [F.count_if(F.col("seconds") <= b).alias(f"le{i}") for i, b in enumerate(bounds)]
    windows = log.groupBy(_per("5 minutes")).agg(F.count(F.lit(1)).alias("requests"), *counts)

    def estimate(q: float) -> Column:
        rank = F.lit(q) * F.col("requests")
        value = F.lit(float(bounds[-1]))
        for i in range(len(bounds) - 1, -1, -1):
            low = F.lit(float(bounds[i - 1]) if i else 0.0)
            under = F.col(f"le{i - 1}") if i else F.lit(0)
            inside = (F.col(f"le{i}") - under).cast("double")
            width = F.lit(float(bounds[i])) - low
            linear = low + width * F.try_divide(rank - under, inside)
            value = F.when(F.col(f"le{i}") >= rank, linear).otherwise(value)
        return value.alias(f"p{round(q * 100)}")

    return windows.select("window_start", "requests", *[estimate(q) for q in quantiles])


def rate_limit(log: DataFrame, limit: int = 100, width: str = "60 seconds") -> DataFrame:
    """Requests per client and fixed window, and how many of them exceed the limit."""
    return log.groupBy("client", _per(width)).agg(
        F.count(F.lit(1)).alias("requests"),
        F.greatest(F.count(F.lit(1)) - F.lit(limit), F.lit(0)).alias("rejected"),
    )
