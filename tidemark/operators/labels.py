"""Interval labels for univariate series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BIN_SECONDS = 3600


def _bin(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(BIN_SECONDS * 1_000_000))


def binned_intervals(intervals: DataFrame) -> DataFrame:
    """Intervals cut into hour bins and merged inside each bin: (stream, bin, start, end),
    disjoint, so a point lies in at most one.

    Merging sorts one bin's pieces at a time, never a whole stream's.
    """
    cut = intervals.select(
        "stream",
        "start",
        "end",
        F.explode(F.sequence(_bin(F.col("start")), _bin(F.col("end")))).alias("bin"),
    )
    # A piece that starts before its bin starts with it; ends need no cut, as only points of
    # the bin are compared with it.
    opening = F.timestamp_seconds(F.col("bin") * BIN_SECONDS)
    pieces = cut.select(
        "stream", "bin", F.greatest("start", opening).alias("start"), "end"
    ).groupBy("stream", "bin", "start").agg(F.max("end").alias("end"))
    ordered = Window.partitionBy("stream", "bin").orderBy("start")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = pieces.withColumn("_before", before).withColumn(
        "_new", (F.col("_before").isNull() | (F.col("start") > F.col("_before"))).cast("int")
    )
    island = F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return (
        opened.withColumn("_island", island)
        .groupBy("stream", "bin", "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_island")
    )


def interval_label(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds ``is_anomaly``: 1 where the time lies in an interval of its stream, ends included.

    A range condition alone would compare every point with every interval. The hour bins make
    it an equi-join on (stream, bin) that Spark may broadcast or shuffle by measured size, and
    that spreads a stream holding most points over its hours.
    """
    p = points.withColumn("_bin", _bin(F.col("ts"))).alias("p")
    d = binned_intervals(intervals).alias("d")
    inside = (
        (F.col("p.stream") == F.col("d.stream"))
        & (F.col("p._bin") == F.col("d.bin"))
        & F.col("p.ts").between(F.col("d.start"), F.col("d.end"))
    )
    return p.join(d, inside, "left").select(
        *[F.col(f"p.{c}").alias(c) for c in points.columns],
        F.col("d.start").isNotNull().cast("int").alias("is_anomaly"),
    )
