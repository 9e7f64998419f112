"""Per-tenant features: day index, standardised metrics, rolling z-scores, windows.

All windows share ``tenant_id`` as partition key, so a chain of these operators needs one
shuffle. A window partition is one tenant's daily rows, bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import numeric_or_zero
from tidemark.schemas import METRICS


def _by_day():
    return Window.partitionBy("tenant_id").orderBy("metric_date")


def _whole():
    return Window.partitionBy("tenant_id")


def adapt(gold: DataFrame) -> DataFrame:
    """Gold rows → the four metrics; undefined rates become 0."""
    frame = gold
    if "checkout_volume" not in frame.columns:
        parts = [c for c in ("checkouts_completed", "checkouts_expired") if c in frame.columns]
        volume = F.lit(0.0)
        for part in parts:
            volume = volume + numeric_or_zero(F.col(part))
        frame = frame.withColumn("checkout_volume", volume)
    missing = [m for m in METRICS if m not in frame.columns]
    if missing:
        raise ValueError(f"gold frame lacks required metrics: {missing}")
    return frame.select(
        "tenant_id", "metric_date", *[numeric_or_zero(F.col(m)).alias(m) for m in METRICS]
    )


def day_index(frame: DataFrame) -> DataFrame:
    """0-based ordinal of the day within its tenant."""
    return frame.withColumn("day", F.row_number().over(_by_day()) - 1)


def _nonzero(std: Column) -> Column:
    return F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std)


def standardise(frame: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Adds ``z_<metric>``: distance from the tenant's mean in population deviations."""
    whole = _whole()
    return frame.select(
        "*",
        *[
            (
                (F.col(m) - F.avg(m).over(whole)) / _nonzero(F.stddev_pop(m).over(whole))
            ).alias(f"z_{m}")
            for m in metrics
        ],
    )


def baseline(frame: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Mean and sample deviation per tenant and metric."""
    return frame.groupBy("tenant_id").agg(
        *[
            column
            for m in metrics
            for column in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))
        ]
    )


def with_baseline(frame: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """The baseline on every row: as windows, on the partitioning the frame already has."""
    whole = _whole()
    return frame.select(
        "*",
        *[F.avg(m).over(whole).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(m).over(whole).alias(f"{m}_std") for m in metrics],
    )


def rolling_zscore(
    frame: DataFrame,
    window: int = 7,
    metrics: list[str] = METRICS,
    key: str = "tenant_id",
    order: str = "metric_date",
    name: str = "zscore",
) -> DataFrame:
    """Largest absolute z-score over the metrics against the trailing ``window`` rows."""
    trailing = Window.partitionBy(key).orderBy(order).rowsBetween(-(window - 1), 0)
    scores = [
        F.abs(
            (F.col(m) - F.avg(m).over(trailing)) / _nonzero(F.stddev_samp(m).over(trailing))
        )
        for m in metrics
    ]
    return frame.withColumn(name, F.greatest(*scores) if len(scores) > 1 else scores[0])


def sliding_windows(
    frame: DataFrame, window: int = 7, columns: list[str] | None = None
) -> DataFrame:
    """Flat array of the last ``window`` days' values, day by day; NULL until there are
    enough days."""
    columns = columns or [f"z_{m}" for m in METRICS]
    trailing = _by_day().rowsBetween(-(window - 1), 0)
    rows = F.collect_list(F.array(*columns)).over(trailing)
    return frame.withColumn("_rows", rows).select(
        *frame.columns,
        F.when(F.size("_rows") == window, F.flatten("_rows")).alias("window_values"),
    )


def warmup_backfill(frame: DataFrame, column: str) -> DataFrame:
    """Days without a value take the tenant's first value, 0 where it has none."""
    everything = _by_day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(column, ignorenulls=True).over(everything)
    return frame.withColumn(column, F.coalesce(F.col(column), first, F.lit(0.0)))


def ar2_residual(frame: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Adds ``ar2``: the largest standardised absolute AR(2) residual over the metrics.

    y(t) on a constant, y(t−1) and y(t−2) by conditional least squares per tenant, from
    centred second moments. The two first days have no lags and use the distance from the
    mean; a singular system scores 0.
    """
    ordered, whole = _by_day(), _whole()
    step = frame.select(
        "*",
        *[
            F.lag(m, k).over(ordered).alias(f"_{m}_{k}")
            for m in metrics
            for k in (1, 2)
        ],
    )

    def usable(m: str, value: Column) -> Column:
        return F.when(F.col(f"_{m}_2").isNotNull(), value)

    means = []
    for m in metrics:
        means += [
            F.avg(m).over(whole).alias(f"_{m}_all"),
            F.avg(usable(m, F.col(m))).over(whole).alias(f"_{m}_my"),
            F.avg(usable(m, F.col(f"_{m}_1"))).over(whole).alias(f"_{m}_m1"),
            F.avg(usable(m, F.col(f"_{m}_2"))).over(whole).alias(f"_{m}_m2"),
        ]
    step = step.select("*", *means)

    def centred(m: str, part: str) -> Column:
        source, mean = {
            "y": (m, f"_{m}_my"),
            "1": (f"_{m}_1", f"_{m}_m1"),
            "2": (f"_{m}_2", f"_{m}_m2"),
        }[part]
        return F.col(source) - F.col(mean)

    moments = []
    for m in metrics:
        for a, b in (("1", "1"), ("2", "2"), ("1", "2"), ("1", "y"), ("2", "y")):
            product = usable(m, centred(m, a) * centred(m, b))
            moments.append(F.sum(product).over(whole).alias(f"_{m}_s{a}{b}"))
    step = step.select("*", *moments)

    residuals = []
    for m in metrics:
        s11, s22, s12 = F.col(f"_{m}_s11"), F.col(f"_{m}_s22"), F.col(f"_{m}_s12")
        s1y, s2y = F.col(f"_{m}_s1y"), F.col(f"_{m}_s2y")
        det = s11 * s22 - s12 * s12
        solvable = det > F.lit(1e-9) * s11 * s22
        a1 = F.when(solvable, (s1y * s22 - s2y * s12) / det)
        a2 = F.when(solvable, (s2y * s11 - s1y * s12) / det)
        fitted = centred(m, "y") - a1 * centred(m, "1") - a2 * centred(m, "2")
        early = F.when(solvable, F.col(m) - F.col(f"_{m}_all"))
        residuals.append(
            F.abs(F.when(F.col(f"_{m}_2").isNull(), early).otherwise(fitted)).alias(f"_{m}_r")
        )
    step = step.select("*", *residuals)
    scores = []
    for m in metrics:
        r = F.col(f"_{m}_r")
        spread = F.stddev_pop(r).over(whole) + F.lit(1e-9)
        scores.append(F.coalesce((r - F.avg(r).over(whole)) / spread, F.lit(0.0)))
    return step.select(*frame.columns, F.greatest(*scores).alias("ar2"))
