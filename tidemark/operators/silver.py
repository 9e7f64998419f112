"""Typed, deduplicated events and their KPI contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import epoch_ts, payload_struct, strict_cents
from tidemark.schemas import (
    CHARGE_REFUNDED,
    CHECKOUT_DONE,
    CHECKOUT_EXPIRED,
    INVOICE_FAILED,
    INVOICE_PAID,
    SUB_CREATED,
    SUB_DELETED,
)


def first_delivery(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row per key by a total order.

    ``row_number() = 1`` lets Catalyst keep at most one row per key in each map task
    (WindowGroupLimit) before the shuffle, so a key delivered a billion times sends one row
    per task.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def to_silver(bronze: DataFrame) -> DataFrame:
    """Parses the payload once, then dedupes on the narrow typed columns.

    Equal ``ingested_at`` is settled by the payload hash. Parsing first means the shuffle
    carries only the columns the consumer reads, never the JSON text.
    """
    typed = bronze.select(
        "event_id",
        "tenant_id",
        "event_type",
        epoch_ts(F.col("created_epoch")).alias("event_ts"),
        payload_struct(F.col("payload")).alias("p"),
        "livemode",
        "ingested_at",
        F.xxhash64("payload").alias("payload_hash"),
    ).select(
        "event_id",
        "tenant_id",
        "event_type",
        "event_ts",
        F.to_date("event_ts").alias("event_date"),
        F.col("p.id").alias("object_id"),
        F.col("p.customer").alias("customer_id"),
        F.col("p.subscription").alias("subscription_id"),
        F.col("p.status").alias("status"),
        F.col("p.currency").alias("currency"),
        strict_cents(F.col("p.amount")).alias("amount_cents"),
        "livemode",
        "ingested_at",
        "payload_hash",
    )
    order = [F.col("ingested_at").asc_nulls_last(), F.col("payload_hash")]
    return first_delivery(typed, "event_id", order).drop("ingested_at", "payload_hash")


def _when_type(event_type: str, value: Column) -> Column:
    return F.when(F.col("event_type") == event_type, value)


def contribution_columns() -> dict[str, Column]:
    """The KPI contribution of one event, by column name."""
    amount, one = F.col("amount_cents"), F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def only(event_type: str, value: Column) -> Column:
        return _when_type(event_type, value).otherwise(zero)

    return {
        "mrr_delta_cents": _when_type(SUB_CREATED, amount)
        .when(F.col("event_type") == SUB_DELETED, -amount)
        .otherwise(zero),
        "is_new_sub": only(SUB_CREATED, one),
        "is_churned_sub": only(SUB_DELETED, one),
        "gross_revenue_cents": only(INVOICE_PAID, amount),
        "is_successful_payment": only(INVOICE_PAID, one),
        "is_failed_payment": only(INVOICE_FAILED, one),
        "refund_cents": only(CHARGE_REFUNDED, amount),
        "is_checkout_completed": only(CHECKOUT_DONE, one),
        "is_checkout_expired": only(CHECKOUT_EXPIRED, one),
    }


def metric_events(silver: DataFrame) -> DataFrame:
    return silver.select(
        "tenant_id",
        "event_date",
        "event_ts",
        "event_id",
        "event_type",
        *[column.alias(name) for name, column in contribution_columns().items()],
    )
