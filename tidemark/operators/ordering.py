"""Ranks and running sums over a whole table or over groups of any size.

A window without a partition key, or with one that holds a third of all rows, sorts that
group in one task. Here rows are range-partitioned on (group, order) instead, sorted inside
each partition and numbered there; the numbering is written to the shared checkpoint folder,
so both later passes see the same placement whatever is recomputed. What remains is one
offset per partition and group, a table bounded by partitions + groups.

``order`` must be total (end it with a key): equal rows would otherwise share a partition
and have no defined rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import join_small
from tidemark.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _placed(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    keys = [*[F.col(c) for c in by], *order]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = (
        rows.repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    return cut_lineage(
        numbered.withColumn("_part", F.shiftright("_id", _LOCAL_BITS))
        .withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_id")
    )


def _join_offsets(placed: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return join_small(placed, offsets, [*by, "_part"])
    # Without groups there is one offset row per range partition: a proven bound.
    return placed.join(F.broadcast(offsets), "_part")


def _group(by: list[str]) -> list:
    return [F.col(c) for c in by] or [F.lit(0)]


def ranked(
    rows: DataFrame,
    order: list[Column],
    by: list[str] | None = None,
    rank: str = "rank",
    total: str = "total",
) -> DataFrame:
    """Adds the 0-based rank and the row count of the group (of the table without ``by``).

    Runs its jobs before returning: the placement (and, by group, the offsets) are written.
    """
    by = by or []
    placed = _placed(rows, by, order)
    whole = Window.partitionBy(*_group(by))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
        .select(
            *by,
            "_part",
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_n").over(whole).alias(total),
        )
    )
    return (
        _join_offsets(placed, offsets, by)
        .withColumn(rank, F.col("_pos") + F.col("_shift"))
        .drop("_part", "_pos", "_shift")
    )


def running_sums(
    rows: DataFrame,
    sums: dict[str, str],
    order: list[Column],
    by: list[str] | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Adds cumulative sums (``{new_column: source_column}``) in the given order, and group
    totals where ``totals`` names them.

    Runs its jobs before returning: the placement and the offsets are written.
    """
    totals = totals or {}
    by = by or []
    placed = _placed(rows, by, order)
    whole = Window.partitionBy(*_group(by))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "_part")
        .agg(
            *[F.sum(source).alias(f"_t_{name}") for name, source in (sums | totals).items()],
        )
        .select(
            *by,
            "_part",
            *[
                F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
                for name in sums
            ],
            *[F.sum(f"_t_{name}").over(whole).alias(name) for name in totals],
        )
    )
    # One window partition is one range partition of one group: balanced by construction.
    local = (
        Window.partitionBy(*by, "_part")
        .orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = placed.select(
        "*", *[F.sum(source).over(local).alias(f"_l_{name}") for name, source in sums.items()]
    )
    out = _join_offsets(summed, offsets, by)
    for name in sums:
        out = out.withColumn(name, F.col(f"_l_{name}") + F.col(f"_o_{name}"))
    return out.select(*rows.columns, *sums, *totals)


def rank_percentile(
    rows: DataFrame, column: str, tie_break: list[str], name: str, by: list[str] | None = None
) -> DataFrame:
    """Ascending rank over (n − 1), in [0, 1]; 0 where a single row is all there is."""
    order = [F.col(column).asc(), *[F.col(c).asc() for c in tie_break]]
    out = ranked(rows, order, by, rank="_rank", total="_total")
    share = F.col("_rank").cast("double") / (F.col("_total") - 1).cast("double")
    return out.withColumn(name, F.when(F.col("_total") <= 1, F.lit(0.0)).otherwise(share)).drop(
        "_rank", "_total"
    )
