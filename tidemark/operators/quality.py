"""Data-quality gates.

A suite is a list of checks; all counts of a suite come from one aggregate over the table,
and the report is that single row turned into one row per check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    expectation: str
    column: str
    unexpected: Column | None = None
    passes: bool | None = None


def _row_count() -> Check:
    empty = F.when(F.count(F.lit(1)) >= 1, 0).otherwise(1)
    return Check("row_count_at_least_1", "*", empty)


def _exists(df: DataFrame, column: str) -> Check:
    return Check("column_exists", column, passes=column in df.columns)


def _not_null(df: DataFrame, column: str) -> Check:
    if column not in df.columns:
        return Check("not_null", column, passes=False)
    return Check("not_null", column, F.count_if(F.col(column).isNull()))


def _between(df: DataFrame, column: str, low: float | None, high: float | None) -> Check:
    if column not in df.columns:
        return Check("between", column, passes=False)
    value, outside = F.col(column), F.lit(False)
    if low is not None:
        outside = outside | (value < low)
    if high is not None:
        outside = outside | (value > high)
    return Check("between", column, F.count_if(outside))


# The columns each suite requires and checks.
RATES = ["churn_rate", "refund_rate", "payment_failure_rate", "conversion_rate"]


def bronze_checks(df: DataFrame) -> list[Check]:
    return [
        _row_count(),
        *[_exists(df, c) for c in ("event_id", "tenant_id", "event_type", "payload")],
        *[_not_null(df, c) for c in ("event_id", "tenant_id", "event_type")],
    ]


def gold_checks(df: DataFrame) -> list[Check]:
    return [
        _row_count(),
        *[_exists(df, c) for c in ("tenant_id", "metric_date", "mrr", "active_subscriptions")],
        *[_not_null(df, c) for c in ("tenant_id", "metric_date", "mrr")],
        _between(df, "active_subscriptions", 0, None),
        *[_between(df, c, 0, 1) for c in RATES],
    ]


def silver_checks(df: DataFrame) -> list[Check]:
    return [_row_count(), *[_not_null(df, c) for c in ("event_id", "tenant_id", "event_type")]]


def report(df: DataFrame, suite: str, checks: list[Check]) -> DataFrame:
    """One row per check: how many rows were unexpected, and whether the check passed."""
    counts = [F.count(F.lit(1)).alias("rows")]
    lines = []
    for i, check in enumerate(checks):
        if check.unexpected is None:
            unexpected = F.lit(0 if check.passes else 1)
        else:
            counts.append(check.unexpected.cast("bigint").alias(f"u{i}"))
            unexpected = F.col(f"u{i}")
        lines.append(
            F.struct(
                F.lit(suite).alias("suite"),
                F.lit(check.expectation).alias("expectation"),
                F.lit(check.column).alias("column"),
                F.col("rows").alias("rows"),
                unexpected.cast("bigint").alias("unexpected"),
                (unexpected == 0).alias("success"),
            )
        )
    return df.agg(*counts).select(F.explode(F.array(*lines)).alias("line")).select("line.*")


def suite_summary(reports: DataFrame) -> DataFrame:
    """Per suite: passed/total, row count, failing checks and the overall status."""
    failing = F.when(~F.col("success"), F.concat_ws(":", "expectation", "column"))
    return (
        reports.groupBy("suite")
        .agg(
            F.count_if("success").alias("passed"),
            F.count(F.lit(1)).alias("total"),
            F.max("rows").alias("rows"),
            F.array_join(F.array_sort(F.collect_list(failing)), ",").alias("failing"),
        )
        .withColumn("status", F.when(F.col("passed") == F.col("total"), "PASS").otherwise("FAIL"))
    )


class GateBreach(RuntimeError):
    """A suite failed, so nothing is handed on."""


def enforce(summary: DataFrame) -> None:
    """Runs the gates; raises on a breach. One row per suite reaches the driver."""
    failed = [r for r in summary.collect() if r["status"] != "PASS"]
    if failed:
        raise GateBreach("; ".join(f"{r['suite']}: {r['failing']}" for r in failed))
