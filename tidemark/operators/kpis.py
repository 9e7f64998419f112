"""Daily and running KPIs.

Events are reduced to one row per tenant and day by a hash aggregate with map-side partial
sums, so a tenant holding a third of all events costs no more than its number of days. The
running windows then work on those daily rows: a window partition holds one tenant's days,
which the calendar bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import dollars, live_cents, safe_ratio
from tidemark.operators.silver import contribution_columns
from tidemark.schemas import (
    CHARGE_REFUNDED,
    CHECKOUT_DONE,
    CHECKOUT_EXPIRED,
    INVOICE_PAID,
    SUB_CREATED,
    SUB_DELETED,
)


def daily_kpi(silver: DataFrame) -> DataFrame:
    """Nine sums per tenant and day."""
    names = {
        "mrr_delta_cents": "mrr_delta_cents",
        "is_new_sub": "new_subscriptions",
        "is_churned_sub": "churned_subscriptions",
        "gross_revenue_cents": "gross_revenue_cents",
        "refund_cents": "refund_cents",
        "is_successful_payment": "successful_payments",
        "is_failed_payment": "failed_payments",
        "is_checkout_completed": "checkouts_completed",
        "is_checkout_expired": "checkouts_expired",
    }
    contributions = contribution_columns()
    return silver.groupBy("tenant_id", F.col("event_date").alias("metric_date")).agg(
        *[F.sum(contributions[source]).alias(name) for source, name in names.items()]
    )


def _to_date_window():
    return (
        Window.partitionBy("tenant_id")
        .orderBy("metric_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def running_totals(daily: DataFrame) -> DataFrame:
    """Cumulative MRR cents and active subscriptions, one window pass."""
    window = _to_date_window()
    return daily.select(
        "*",
        F.sum("mrr_delta_cents").over(window).alias("mrr_cents_cum"),
        F.sum(F.col("new_subscriptions") - F.col("churned_subscriptions"))
        .over(window)
        .alias("active_subscriptions"),
    )


def churn_rate() -> Column:
    """Churned over those active at the start of the day."""
    opening = F.col("active_subscriptions") - F.col("new_subscriptions")
    return safe_ratio(
        F.col("churned_subscriptions"), opening + F.col("churned_subscriptions")
    )


def gold(daily: DataFrame) -> DataFrame:
    """The fifteen-column KPI row per tenant and day."""
    return gold_rows(running_totals(daily))


def gold_rows(totals: DataFrame) -> DataFrame:
    """Gold from the daily sums with their running totals."""
    c = F.col
    return totals.select(
        "tenant_id",
        "metric_date",
        dollars(c("mrr_cents_cum")).alias("mrr"),
        "active_subscriptions",
        "new_subscriptions",
        "churned_subscriptions",
        churn_rate().alias("churn_rate"),
        dollars(c("gross_revenue_cents")).alias("gross_revenue"),
        dollars(c("refund_cents")).alias("refund_amount"),
        safe_ratio(c("refund_cents"), c("gross_revenue_cents")).alias("refund_rate"),
        "successful_payments",
        "failed_payments",
        safe_ratio(
            c("failed_payments"), c("failed_payments") + c("successful_payments")
        ).alias("payment_failure_rate"),
        "checkouts_completed",
        "checkouts_expired",
        safe_ratio(
            c("checkouts_completed"), c("checkouts_completed") + c("checkouts_expired")
        ).alias("conversion_rate"),
    )


def live_contributions() -> dict[str, Column]:
    """Live-path contributions: an amount that cannot be read counts as 0."""
    kind, amount = F.col("event_type"), live_cents(F.col("amount"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return {
        "mrr_delta_cents": F.when(kind == SUB_CREATED, amount)
        .when(kind == SUB_DELETED, -amount)
        .otherwise(zero),
        "gross_cents": F.when(kind == INVOICE_PAID, amount).otherwise(zero),
        "refund_cents": F.when(kind == CHARGE_REFUNDED, amount).otherwise(zero),
        "completed": F.when(kind == CHECKOUT_DONE, one).otherwise(zero),
        "expired": F.when(kind == CHECKOUT_EXPIRED, one).otherwise(zero),
    }


def live_daily(events: DataFrame) -> DataFrame:
    """Five sums per tenant and day from (tenant_id, event_date, event_type, amount).

    Any event type opens the day's row.
    """
    sums = [F.sum(col).alias(name) for name, col in live_contributions().items()]
    return events.groupBy("tenant_id", F.col("event_date").alias("metric_date")).agg(*sums)


def live_kpis(daily: DataFrame) -> DataFrame:
    """Daily sums → the live KPI row; undefined rates are 0."""
    c = F.col
    checkouts = c("completed") + c("expired")
    return daily.select(
        "tenant_id",
        "metric_date",
        dollars(F.sum("mrr_delta_cents").over(_to_date_window())).alias("mrr"),
        safe_ratio(c("completed"), checkouts, 0.0).alias("conversion_rate"),
        safe_ratio(c("refund_cents"), c("gross_cents"), 0.0).alias("refund_rate"),
        checkouts.cast("double").alias("checkout_volume"),
    )


def mismatches(
    expected: DataFrame, actual: DataFrame, keys: list[str], columns: list[str]
) -> DataFrame:
    """Expected rows whose actual values are missing or differ, null-safe."""
    a, e = actual.alias("a"), expected.alias("e")
    on = [F.col(f"e.{k}") == F.col(f"a.{k}") for k in keys]
    differs = F.col(f"a.{keys[0]}").isNull()
    for name in columns:
        differs = differs | ~F.col(f"e.{name}").eqNullSafe(F.col(f"a.{name}"))
    return (
        e.join(a, on, "left")
        .where(differs)
        .select(
            *[F.col(f"e.{k}").alias(k) for k in keys],
            *[F.col(f"e.{n}").alias(f"expected_{n}") for n in columns],
            *[F.col(f"a.{n}").alias(f"actual_{n}") for n in columns],
        )
    )


def duplicated_grain(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
