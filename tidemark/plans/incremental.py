"""Gold kept up by batches: only the tenant-days that a batch touches are worked out again.

Three change logs, each divided by day and batch: the ids and amounts of the events counted so
far, the nine sums per tenant and day, and the running totals' movement per tenant and month. A
batch reads of each only the days, or months, of its own rows, however old they are: sums are
additive, so a day's new sums are its old ones plus those of the events that are new. Running
totals are never carried forward into later rows; a range of days is read with the movement of
the months before it as its opening totals, so reading a month costs that month's days and one
row per tenant and earlier month.

Every event counts once, under the date it was first delivered with; a copy has that date. A batch
that is applied again replaces its own rows. Batches are applied one after the other.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import kpis, silver
from tidemark.session import path_exists
from tidemark.sources.sinks import LOG_DAY, newest_wins, upsert_batch

_SUMS = [
    "mrr_delta_cents", "new_subscriptions", "churned_subscriptions", "gross_revenue_cents",
    "refund_cents", "successful_payments", "failed_payments", "checkouts_completed",
    "checkouts_expired",
]
_MOVING = _SUMS[:3]
_EVENTS = "event_id string, tenant_id string, event_type string, amount_cents bigint, event_date date"
_DAILY = "tenant_id string, metric_date date, " + ", ".join(f"{c} bigint" for c in _SUMS)
_MONTHS = "tenant_id string, month date, " + ", ".join(f"{c} bigint" for c in _MOVING)
_LOGGED = f", batch_id bigint, {LOG_DAY} date"


def _within(column: str, days: list) -> Column:
    """Days among ``days``, which may hold a null."""
    named = F.col(column).isin([d for d in days if d is not None])
    return named | F.col(column).isNull() if None in days else named


def _log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _added(held: DataFrame, increments: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """The rows of ``increments`` plus what is held of their keys."""
    both = [F.col(f"held.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    old = held.alias("held").join(increments.alias("new"), both, "left_semi")
    names = [*keys, *sums]
    return old.select(*names).unionByName(increments.select(*names)).groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in sums)
    )


def apply_batch(spark: SparkSession, bronze: DataFrame, root: str, batch_id: int) -> None:
    """Counts the events of ``bronze`` that were not counted before."""
    typed = silver.to_silver(bronze).select("event_id", "tenant_id", "event_type", "amount_cents", "event_date")
    # one row per calendar day of the batch
    days = [r[0] for r in typed.select("event_date").distinct().collect()]
    known = _log(spark, f"{root}/events", f"{_EVENTS}, batch_id bigint")
    known = known.where((F.col("batch_id") < batch_id) & _within("event_date", days)).alias("known")
    same = F.col("fresh.event_id").eqNullSafe(F.col("known.event_id"))
    fresh = typed.alias("fresh").join(known.select("event_id"), same, "left_anti")
    target = f"{root}/events/batch_id={batch_id}"
    # a day's rows meet before they are written, or every task would write a file per day
    fresh.hint("rebalance", "event_date").write.mode("overwrite").partitionBy("event_date").parquet(target)
    increments = kpis.daily_kpi(spark.read.schema(_EVENTS).parquet(target))

    daily = _log(spark, f"{root}/daily", _DAILY + _LOGGED)
    daily = daily.where((F.col("batch_id") < batch_id) & _within(LOG_DAY, days)).drop(LOG_DAY)
    daily = newest_wins(daily, ["tenant_id", "metric_date"], "batch_id")
    rows = _added(daily, increments, ["tenant_id", "metric_date"], _SUMS)
    upsert_batch(rows.hint("rebalance", "metric_date"), f"{root}/daily", batch_id, "metric_date")

    months = list({d and d.replace(day=1) for d in days})
    moved = increments.groupBy("tenant_id", F.trunc("metric_date", "month").alias("month")).agg(
        *(F.sum(c).alias(c) for c in _MOVING)
    )
    held = _log(spark, f"{root}/months", _MONTHS + _LOGGED)
    held = held.where((F.col("batch_id") < batch_id) & _within(LOG_DAY, months)).drop(LOG_DAY)
    held = newest_wins(held, ["tenant_id", "month"], "batch_id")
    moved = _added(held, moved, ["tenant_id", "month"], _MOVING).hint("rebalance", "month")
    upsert_batch(moved, f"{root}/months", batch_id, "month")


def _plus(a: Column, b: Column) -> Column:
    """Sum in which a null adds nothing, and which is null only if both are."""
    return F.coalesce(a + b, a, b)


def read_gold(
    spark: SparkSession, root: str, first: datetime.date | None = None, last: datetime.date | None = None
) -> DataFrame:
    """Gold rows of the days from ``first`` to ``last``; without ``first`` also those without a day."""
    rows = _log(spark, f"{root}/daily", _DAILY + _LOGGED)
    if last is not None:
        until = F.col(LOG_DAY) <= F.lit(last)
        rows = rows.where(until if first is not None else until | F.col(LOG_DAY).isNull())
    if first is not None:
        rows = rows.where(F.col(LOG_DAY) >= F.lit(first.replace(day=1)))
    rows = newest_wins(rows.drop(LOG_DAY), ["tenant_id", "metric_date"], "batch_id").drop("batch_id")
    totals = kpis.running_totals(rows)
    if first is not None:
        earlier = _log(spark, f"{root}/months", _MONTHS + _LOGGED)
        earlier = earlier.where((F.col(LOG_DAY) < F.lit(first.replace(day=1))) | F.col(LOG_DAY).isNull())
        opening = newest_wins(earlier.drop(LOG_DAY), ["tenant_id", "month"], "batch_id").groupBy("tenant_id").agg(
            F.sum("mrr_delta_cents").alias("_cents"),
            F.sum(F.col("new_subscriptions") - F.col("churned_subscriptions")).alias("_active"),
        )
        opening = opening.withColumnRenamed("tenant_id", "_tenant")
        totals = totals.join(opening, F.col("tenant_id").eqNullSafe(F.col("_tenant")), "left")
        totals = totals.withColumn("mrr_cents_cum", _plus(F.col("mrr_cents_cum"), F.col("_cents")))
        totals = totals.withColumn("active_subscriptions", _plus(F.col("active_subscriptions"), F.col("_active")))
        totals = totals.where(F.col("metric_date") >= F.lit(first))
    return kpis.gold_rows(totals)
