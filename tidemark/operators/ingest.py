"""Webhook bodies → envelopes → bronze rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tidemark.functions.scalars import epoch_date
from tidemark.schemas import BRONZE, ENVELOPE, PROVIDER_EVENT

SOURCE = "stripe"


def parse_webhooks(raw: DataFrame) -> DataFrame:
    """Adds the parsed event, its `data` text and the outcome; no row is dropped.

    A body that is not a JSON object with an id, a type and data is rejected. Signature
    checks belong to the web edge and are not repeated here.
    """
    text = F.col("value").cast("string")
    parsed = raw.select(
        text.alias("value"),
        F.from_json(text, PROVIDER_EVENT).alias("event"),
        F.get_json_object(text, "$.data").alias("data"),
    )
    # text after the object, or a second object, is malformed; only an array shows that
    alone = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), ArrayType(PROVIDER_EVENT))
    complete = (
        F.col("event.id").isNotNull()
        & F.col("event.type").isNotNull()
        & F.col("data").isNotNull()
        & F.coalesce(F.size("alone") == 1, F.lit(False))
    )
    parsed = parsed.withColumn("alone", alone)
    return parsed.withColumn(
        "outcome", F.when(complete, "accepted").otherwise("rejected_payload")
    ).drop("alone").withColumn("source", F.lit(SOURCE))


def envelopes(parsed: DataFrame) -> DataFrame:
    """Envelope columns of the accepted bodies; `data` stays verbatim JSON text."""
    return parsed.where(F.col("outcome") == "accepted").select(
        F.col("event.id").alias("id"),
        "source",
        F.col("event.account").alias("tenant_id"),
        F.col("event.type").alias("event_type"),
        F.coalesce("event.livemode", F.lit(False)).alias("livemode"),
        F.col("event.created").alias("created"),
        F.col("event.api_version").alias("api_version"),
        "data",
    )


def quarantine(parsed: DataFrame) -> DataFrame:
    """The rejected bodies, kept as they arrived."""
    return parsed.where(F.col("outcome") != "accepted").select("source", "outcome", "value")


def outcome_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("events"))


_DECODED = StructType(
    [
        *(f if f.name != "created" else StructField("created", StringType()) for f in ENVELOPE.fields),
        StructField("data", StructType([StructField("object", StringType())])),
    ]
)


def to_bronze(raw: DataFrame) -> DataFrame:
    """Bus records (`value` bytes) → bronze rows, from one parse of each record.

    Undecodable records become all-null rows. `created` is epoch seconds or an ISO text.
    """
    event = raw.select(F.from_json(F.col("value").cast("string"), _DECODED).alias("event"))
    created = F.coalesce(
        F.col("event.created").try_cast("bigint"),
        F.unix_seconds(F.col("event.created").try_cast("timestamp")),
    )
    filled = {
        "event_id": F.col("event.id"),
        "created_epoch": created,
        "payload": F.col("event.data.object"),
        "ingested_at": F.current_timestamp(),
        "event_date": epoch_date(created),
    }
    return event.select(*(filled.get(c, F.col(f"event.{c}")).alias(c) for c in BRONZE.names))
