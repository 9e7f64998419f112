"""Detectors for univariate streams of any length: rows (stream, ts, value).

One stream may hold most rows, so nothing is windowed per stream. Rows get their rank within
the stream (range-partitioned), chunks of consecutive ranks become the window partitions, and
each chunk also receives the last rows of the one before it. Per-stream statistics are
partial-sum aggregates that join back as a small side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import forest, temporal
from tidemark.operators.joins import join_small
from tidemark.operators.ordering import rank_percentile, ranked
from tidemark.session import cut_lineage

CHUNK_ROWS = 100_000


def placed(rows: DataFrame, order: list[str], by: str = "stream") -> DataFrame:
    """Adds ``at``, the rank of a row in its stream. Runs its jobs; operators given placed rows
    do not rank again."""
    return ranked(rows, [F.col(c) for c in order], [by], rank="at", total="_total").drop("_total")


def chunked(
    rows: DataFrame, order: list[str], halo: int, by: str = "stream", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Adds ``_chunk`` and ``_own``; rows within ``halo`` of a chunk's end are repeated, not
    owned, in the next chunk."""
    if halo >= chunk_rows:
        raise ValueError("a chunk must be longer than its overlap")
    source = rows if "at" in rows.columns else placed(rows, order, by)
    chunk = F.floor(F.col("at") / F.lit(chunk_rows))
    tail = F.col("at") % F.lit(chunk_rows) >= F.lit(chunk_rows - halo)
    homes = F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    return source.withColumn("_chunk", F.explode(homes)).withColumn(
        "_own", F.col("_chunk") == chunk
    )


def _in_chunk(by: str):
    return Window.partitionBy(by, "_chunk").orderBy("at")


def _owned(rows: DataFrame) -> DataFrame:
    return rows.where("_own").drop("_own", "_chunk")


def _nonzero(std: Column) -> Column:
    return F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std)


def rolling_zscore(
    rows: DataFrame, order: list[str], window: int = 48, by: str = "stream", value: str = "value",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds ``zscore``: distance from the mean of the trailing ``window`` rows, in their sample
    deviations."""
    trailing = _in_chunk(by).rowsBetween(-(window - 1), 0)
    gap = F.col(value) - F.avg(value).over(trailing)
    scored = chunked(rows, order, window - 1, by, chunk_rows).withColumn(
        "zscore", F.abs(gap / _nonzero(F.stddev_samp(value).over(trailing)))
    )
    return _owned(scored).select(*rows.columns, "zscore")


def ar2_residual(
    rows: DataFrame, order: list[str], by: str = "stream", value: str = "value",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds ``ar2``: standardised absolute residual of value(t) on its two predecessors.

    Least squares per stream from its second moments; the first two rows use the distance from
    the mean, and a singular stream scores 0. Runs its statistics jobs.
    """
    step = _in_chunk(by)
    lagged = _owned(
        chunked(rows, order, 2, by, chunk_rows)
        .withColumn("_1", F.lag(value, 1).over(step))
        .withColumn("_2", F.lag(value, 2).over(step))
    )
    usable = F.col("_2").isNotNull()
    y, l1, l2 = (F.when(usable, F.col(c)) for c in (value, "_1", "_2"))
    fitted = join_small(
        lagged,
        lagged.groupBy(by).agg(
            F.avg(value).alias("_mean"),
            F.avg(y).alias("_my"), F.avg(l1).alias("_m1"), F.avg(l2).alias("_m2"),
            F.var_pop(l1).alias("_s11"), F.var_pop(l2).alias("_s22"),
            F.covar_pop(l1, l2).alias("_s12"), F.covar_pop(l1, y).alias("_s1y"),
            F.covar_pop(l2, y).alias("_s2y"),
        ),
        [by],
    )
    s11, s22, s12, s1y, s2y = (F.col(f"_s{n}") for n in ("11", "22", "12", "1y", "2y"))
    det = s11 * s22 - s12 * s12
    solvable = det > F.lit(1e-9) * s11 * s22
    a1, a2 = (s1y * s22 - s2y * s12) / det, (s2y * s11 - s1y * s12) / det
    later = (
        (F.col(value) - F.col("_my"))
        - a1 * (F.col("_1") - F.col("_m1"))
        - a2 * (F.col("_2") - F.col("_m2"))
    )
    residual = F.when(
        solvable, F.abs(F.when(usable, later).otherwise(F.col(value) - F.col("_mean")))
    )
    with_residual = fitted.withColumn("_r", residual)
    spread = with_residual.groupBy(by).agg(
        F.avg("_r").alias("_rm"), F.stddev_pop("_r").alias("_rs")
    )
    score = (F.col("_r") - F.col("_rm")) / (F.col("_rs") + F.lit(1e-9))
    return join_small(with_residual, spread, [by]).select(
        *rows.columns, F.coalesce(score, F.lit(0.0)).alias("ar2")
    )


def reconstruction(
    rows: DataFrame, order: list[str], window: int = 48, by: str = "stream", value: str = "value",
    components: int = 8, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds ``temporal``: error of rebuilding the standardised window that ends on a row.

    One model for the windows of all streams. The first ``window − 1`` rows of a stream take
    its first error. Runs its model jobs.
    """
    stats = rows.groupBy(by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    standard = join_small(rows, stats, [by]).withColumn(
        "_z", (F.col(value) - F.col("_m")) / _nonzero(F.col("_s"))
    )
    trailing = _in_chunk(by).rowsBetween(-(window - 1), 0)
    windows = _owned(
        chunked(standard, order, window - 1, by, chunk_rows).withColumn(
            "_w", F.collect_list("_z").over(trailing)
        )
    ).withColumn("window_values", F.when(F.size("_w") == window, F.col("_w")))
    windows = windows.select(*dict.fromkeys([*rows.columns, "at"]), "window_values")
    scored = temporal.reconstruction_error(windows, temporal.fit(windows, components))
    first = scored.where(F.col("at") == window - 1).select(by, F.col("temporal").alias("_first"))
    return join_small(scored, first, [by], "left").select(
        *rows.columns, F.coalesce("temporal", "_first", F.lit(0.0)).alias("temporal")
    )


def detector_scores(
    rows: DataFrame,
    order: list[str],
    key: list[str],
    window: int = 48,
    weight: float = 0.5,
    trees: int = 200,
) -> DataFrame:
    """Adds zscore, ar2, forest and the rank blend ``ensemble``, each judged within its stream."""
    # Written between the models, whose fitting reads its input several times.
    scored = cut_lineage(ar2_residual(rolling_zscore(placed(rows, order), order, window), order))
    scored = cut_lineage(forest.fit_score_parts(scored, "stream", ["value"], key, trees=trees))
    scored = reconstruction(scored, order, window)
    by_time = rank_percentile(scored, "temporal", key, "_rt", ["stream"])
    both = rank_percentile(by_time, "forest", key, "_rf", ["stream"])
    blend = F.lit(weight) * F.col("_rt") + F.lit(1.0 - weight) * F.col("_rf")
    return both.withColumn("ensemble", blend).drop("_rt", "_rf", "temporal", "at")
