"""Deterministic hold-outs: order by a hash of the key, take the first so many.

The hash is md5 of ``key|seed``, so a split can be repeated by any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import ranked


def shuffle_key(*parts: Column, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def stratified_split(
    rows: DataFrame, label: str, key: str, fraction: float = 0.2, seed: int = 0
) -> DataFrame:
    """Adds ``is_test``: exactly ``int(n · fraction)`` rows of each label.

    Runs one job. A label may hold most rows, so the order within a label is spread over
    range partitions instead of being sorted in one window.
    """
    hashed = rows.withColumn("_h", shuffle_key(F.col(key), seed=seed))
    out = ranked(hashed, [F.col("_h"), F.col(key)], [label], rank="_r", total="_t")
    return out.withColumn("is_test", F.col("_r") < F.floor(F.col("_t") * F.lit(fraction))).drop(
        "_h", "_r", "_t"
    )


def held_out_templates(
    rows: DataFrame, label: str, template: str, per_label: int = 2, seed: int = 0
) -> DataFrame:
    """The templates held out: ``per_label`` distinct ones for each label."""
    distinct = rows.select(label, template).distinct()
    order = Window.partitionBy(label).orderBy(shuffle_key(F.col(template), seed=seed), template)
    return (
        distinct.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= per_label)
        .select(template)
        .distinct()
    )


def held_out_tenants(
    rows: DataFrame, tenant: str = "tenant_id", fraction: float = 0.33, seed: int = 0
) -> DataFrame:
    """The tenants held out: ``int(n · fraction)`` of them, at least one. Runs one job."""
    tenants = rows.select(tenant).distinct().withColumn("_h", shuffle_key(F.col(tenant), seed=seed))
    size = F.greatest(F.lit(1), F.floor(F.col("_t") * F.lit(fraction)))
    return (
        ranked(tenants, [F.col("_h"), F.col(tenant)], rank="_r", total="_t")
        .where(F.col("_r") < size)
        .select(tenant)
    )


def hold_out(rows: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, held-out) rows by membership of the key."""
    return rows.join(held, key, "left_anti"), rows.join(held, key, "left_semi")
