"""Batch readers for bronze CSV, gold tables, labelled series and the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import BRONZE_CSV
from tidemark.session import ensure_utc
from tidemark.sources import published


def supplied(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Deals a scan out over all cores when its files give fewer splits than there are cores.

    For plain scans of few large files ahead of costly per-row work; with enough splits it
    changes nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key)


def read_bronze_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV with JSON text in quotes; embedded quotes are doubled."""
    ensure_utc(spark)
    return spark.read.schema(BRONZE_CSV).csv(path, header=True, escape='"', multiLine=False)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold is stored partitioned by day, in its current version if it has any; order is left to
    the consumers that need it."""
    ensure_utc(spark)
    return spark.read.parquet(published.current(spark, path))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Univariate streams: one CSV per stream, the file name is the stream name."""
    ensure_utc(spark)
    return (
        spark.read.schema("ts timestamp, value double")
        .csv(path, header=True)
        .withColumn("stream", F.element_at(F.split(F.input_file_name(), "/"), -1))
    )


def read_label_windows(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """JSON objects ``{stream: [[start, end], …]}``, one per file or one per line → one row
    per labelled window."""
    text = spark.read.text(path, wholetext=whole_file)
    parsed = text.select(
        F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("stream", "spans")
    )
    return parsed.select(
        F.element_at(F.split("stream", "/"), -1).alias("stream"), F.explode("spans").alias("span")
    ).select(
        "stream",
        F.col("span")[0].cast("timestamp").alias("start"),
        F.col("span")[1].cast("timestamp").alias("end"),
    )
