"""The supplied ``events`` table seen as a payment-provider feed.

Five event types become seven provider event types, five neighbouring users form one tenant
(so tenants grow with the data), and every error event is delivered a second time an hour
later, as a provider does when an acknowledgement is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import (
    CHARGE_REFUNDED,
    CHECKOUT_DONE,
    CHECKOUT_EXPIRED,
    INVOICE_FAILED,
    INVOICE_PAID,
    SUB_CREATED,
    SUB_DELETED,
)
from tidemark.sources.tables import spread, supplied

API_VERSION = "2024-06-20"
REDELIVERY_DELAY_S = 3600


def _provider_type() -> Column:
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    return (
        F.when((kind == "signup") & (k % 4 == 0), SUB_DELETED)
        .when(kind == "signup", SUB_CREATED)
        .when(kind == "purchase", INVOICE_PAID)
        .when((kind == "error") & (k % 2 == 0), CHARGE_REFUNDED)
        .when(kind == "error", INVOICE_FAILED)
        .when(kind == "click", CHECKOUT_DONE)
        .otherwise(CHECKOUT_EXPIRED)
    )


def _payload() -> Column:
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    return F.to_json(
        F.struct(
            F.concat(F.lit("obj_"), F.col("event_id").cast("string")).alias("id"),
            F.when(kind != "view", F.concat(F.lit("cus_"), user)).alias("customer"),
            F.round(F.col("value") * 100).cast("bigint").alias("amount"),
            F.lit("usd").alias("currency"),
            F.when(
                kind.isin("signup", "purchase", "error"), F.concat(F.lit("sub_"), user)
            ).alias("subscription"),
            F.when(kind == "error", "open").otherwise("complete").alias("status"),
        ),
        {"ignoreNullFields": "false"},
    )


def _mapped(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("event_id"),
        F.concat(F.lit("acct_"), F.expr("user_id div 5").cast("string")).alias("tenant_id"),
        _provider_type().alias("event_type"),
        F.unix_timestamp(ts).alias("created_epoch"),
        _payload().alias("payload"),
        F.when(F.col("event_type") == "error", F.array(F.lit(0), F.lit(REDELIVERY_DELAY_S)))
        .otherwise(F.array(F.lit(0)))
        .alias("delays"),
        ts.alias("ts"),
    ).select("*", F.explode("delays").alias("delay_s"))


def bronze_from_events(events: DataFrame) -> DataFrame:
    """Bronze rows, re-deliveries included."""
    return _mapped(events).select(
        "event_id",
        F.lit("stripe").alias("source"),
        "tenant_id",
        "event_type",
        F.lit(False).alias("livemode"),
        "created_epoch",
        F.lit(API_VERSION).alias("api_version"),
        "payload",
        F.timestamp_add("SECOND", F.col("delay_s"), F.col("ts")).alias("ingested_at"),
        F.to_date(F.timestamp_seconds("created_epoch")).alias("event_date"),
    )


def webhooks_from_events(events: DataFrame) -> DataFrame:
    """Raw webhook bodies (``value`` text). Views carry no account; clicks are cut short
    on the wire, so their body is not valid JSON."""
    body = F.concat(
        F.lit('{"id":"'), F.col("event_id"),
        F.lit('","object":"event","type":"'), F.col("event_type"), F.lit('"'),
        F.when(
            F.col("event_type") != CHECKOUT_EXPIRED,
            F.concat(F.lit(',"account":"'), F.col("tenant_id"), F.lit('"')),
        ).otherwise(F.lit("")),
        F.lit(',"created":'), F.col("created_epoch").cast("string"),
        F.lit(f',"api_version":"{API_VERSION}","data":{{"object":'), F.col("payload"), F.lit("}}"),
    )
    damaged = F.col("event_type") == CHECKOUT_DONE
    return _mapped(events).select(
        F.when(damaged, F.substring_index(body, ',"api_version"', 1)).otherwise(body).alias("value")
    )


def envelopes_from_events(events: DataFrame) -> DataFrame:
    """Message-bus records: ``value`` is the envelope as JSON bytes."""
    value = F.concat(
        F.lit('{"id":"'), F.col("event_id"),
        F.lit('","source":"stripe","tenant_id":"'), F.col("tenant_id"),
        F.lit('","event_type":"'), F.col("event_type"),
        F.lit('","livemode":false,"created":'), F.col("created_epoch").cast("string"),
        F.lit(f',"api_version":"{API_VERSION}","data":{{"object":'), F.col("payload"), F.lit("}}"),
    )
    return _mapped(events).select(value.cast("binary").alias("value"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(supplied(spark, sf_dir, "events"), "event_id")


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_from_events(_events(spark, sf_dir))


def webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webhooks_from_events(_events(spark, sf_dir))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes_from_events(_events(spark, sf_dir))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as API requests: route, client, status and latency."""
    return supplied(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("route"),
        F.col("user_id").alias("client"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        (F.col("value") / 200.0).alias("seconds"),
    )
