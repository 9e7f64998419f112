"""Message-bus source and sink options (Kafka where the connector is on the classpath)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import topic_for
from tidemark.schemas import TOPIC_PATTERN

# Micro-batch bounds of the landing job.
MAX_OFFSETS_PER_TRIGGER = 50000
TRIGGER_INTERVAL = "5 seconds"


def read_bus(
    spark: SparkSession,
    servers: str,
    pattern: str = TOPIC_PATTERN,
    starting_offsets: str = "latest",
    max_offsets: int = MAX_OFFSETS_PER_TRIGGER,
    **options: str,
) -> DataFrame:
    """Streaming source over all tenant topics, bounded per micro-batch."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", pattern)
        .option("startingOffsets", starting_offsets)
        .option("maxOffsetsPerTrigger", max_offsets)
        .options(**options)
        .load()
    )


def read_files_as_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_format: str = "parquet",
    glob: str | None = None,
    max_files_per_trigger: int = 64,
) -> DataFrame:
    """The same role without a broker: a file stream bounded by files per micro-batch."""
    reader = (
        spark.readStream.schema(schema)
        .format(file_format)
        .option("maxFilesPerTrigger", max_files_per_trigger)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def bus_records(envelopes: DataFrame) -> DataFrame:
    """Envelope columns → (topic, key, value); the tenant key keeps a tenant's order.

    ``data`` is JSON text and is placed verbatim, so nothing is re-encoded on the way.
    """
    head = F.to_json(
        F.struct(
            F.col("id"),
            F.col("source"),
            F.col("tenant_id"),
            F.col("event_type"),
            F.col("livemode"),
            F.col("created"),
            F.col("api_version"),
        ),
        {"ignoreNullFields": "false"},
    )
    value = F.concat(
        F.expr("substring(head, 1, length(head) - 1)"),
        F.lit(',"data":'),
        F.coalesce("data", F.lit("null")),
        F.lit("}"),
    )
    return envelopes.withColumn("head", head).select(
        topic_for(F.col("tenant_id")).alias("topic"),
        F.when(F.coalesce("tenant_id", F.lit("")) != "", F.col("tenant_id")).alias("key"),
        value.alias("value"),
    )


def write_bus(records: DataFrame, servers: str, **options: str) -> None:
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).options(
        **options
    ).save()
