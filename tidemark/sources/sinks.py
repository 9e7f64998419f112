"""Sinks: partitioned bronze, keyed upsert logs, JSON bundle.

An upsert table is an append-only change log: every batch writes its rows under its own
``batch_id`` folder (writing the same batch again replaces that folder, so a retried batch
changes nothing), and readers keep the newest row of each key. No file that is being read is
ever rewritten, so a lost executor or driver leaves the previous state intact. ``compact`` writes
the newest rows as a new log, which later batches go on with.

A log with a day is divided by it below the batch, so that a batch which must know the present
rows reads only the days it touches. A batch holds a key once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructType

from tidemark.session import path_exists

LOG_DAY = "log_day"


def write_bronze(bronze: DataFrame, path: str, mode: str = "append") -> None:
    """Batch backfill or compaction: folders by day, rows clustered by tenant inside.

    The rebalance hint gathers a day in few files and lets AQE split a day that is too large
    for one task; the sort gives the row groups narrow tenant ranges, so a tenant filter skips
    most of them without a folder per tenant and day.
    """
    (
        bronze.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "tenant_id")
        .write.mode(mode)
        .partitionBy("event_date")
        .parquet(path)
    )


def write_gold(gold: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Folders by day, rows in order of tenants inside, so a tenant's history skips row groups."""
    (
        gold.hint("rebalance", "metric_date")
        .sortWithinPartitions("metric_date", "tenant_id")
        .write.mode(mode)
        .partitionBy("metric_date")
        .parquet(path)
    )


def upsert_batch(rows: DataFrame, path: str, batch_id: int, day: str | None = None) -> None:
    """Writes whole rows as the newest of their keys; ``day`` names a column with their day."""
    target = f"{path}/batch_id={batch_id}"
    if day is None:
        rows.write.mode("overwrite").parquet(target)
    else:
        dated = rows.withColumn(LOG_DAY, F.to_date(day))
        dated.write.mode("overwrite").partitionBy(LOG_DAY).parquet(target)


def read_upserted(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row of each key."""
    return newest_wins(spark.read.parquet(path), keys, "batch_id").drop("batch_id", LOG_DAY)


def upsert_columns(
    changes: DataFrame, path: str, batch_id: int, keys: list[str], updated: list[str], day: str
) -> None:
    """Upsert in which a key that the log holds only takes the ``updated`` columns and a new key
    is inserted whole.

    Only earlier batches count as held, so a retried batch does not see itself. Folders of other
    days are not read.
    """
    spark = changes.sparkSession
    if not path_exists(spark, path):
        upsert_batch(changes, path, batch_id, day)
        return
    stored = StructType([*changes.schema.fields]).add("batch_id", LongType()).add(LOG_DAY, DateType())
    days = changes.select(F.to_date(day).alias(LOG_DAY)).distinct()
    earlier = (
        spark.read.schema(stored).parquet(path)
        .where(F.col("batch_id") < batch_id)
        .join(F.broadcast(days), LOG_DAY, "left_semi")  # a row per calendar day
    )
    held = newest_wins(earlier.drop(LOG_DAY), keys, "batch_id").withColumnRenamed(
        "batch_id", "__held"
    )
    on = [F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}")) for k in keys]
    rows = changes.alias("new").join(held.alias("old"), on, "left")
    inserted = F.col("old.__held").isNull()
    columns = [
        F.col(f"new.{c}")
        if c in keys or c in updated
        else F.when(inserted, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
        for c in changes.columns
    ]
    upsert_batch(rows.select(*columns), path, batch_id, day)


def compact(spark: SparkSession, path: str, into: str, keys: list[str]) -> None:
    """Writes the newest row of each key as the one batch of a new log, under the number of the
    last one; ``path`` stays as it is for its readers."""
    log = spark.read.parquet(path)
    last = log.agg(F.max("batch_id")).first()[0]
    writer = newest_wins(log, keys, "batch_id").drop("batch_id").write.mode("overwrite")
    if LOG_DAY in log.columns:
        writer = writer.partitionBy(LOG_DAY)
    writer.parquet(f"{into}/batch_id={last}")


def newest_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Newest row per key by ``order``, as an aggregate so that copies of a hot key are
    reduced before the shuffle."""
    others = [c for c in rows.columns if c not in keys and c != order]
    latest = F.max_by(F.struct(*others), F.col(order)).alias("row")
    return (
        rows.groupBy(*keys)
        .agg(latest, F.max(order).alias(order))
        .select(*keys, *[F.col("row")[c].alias(c) for c in others], order)
    )


def new_tenants(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Tenants to insert: those seen that are not known yet."""
    return seen.select("tenant_id").distinct().join(known, "tenant_id", "left_anti")


def bundle_json(alerts: DataFrame) -> DataFrame:
    """One JSON document per alert, nested fields included."""
    return alerts.select(F.to_json(F.struct(*alerts.columns)).alias("value"))


def write_bundle(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("overwrite").json(path)
