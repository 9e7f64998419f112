"""Joins with a side that is usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

BROADCAST_ROWS = 500_000  # of the narrow rows joined here: some ten megabytes


def join_small(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins ``rows`` with a side that is broadcast only if its counted size allows it.

    The side is written first, so counting it does not compute it twice. Beyond the bound it
    has so many keys that an ordinary shuffle join spreads, and AQE splits what stays skewed.
    """
    held = cut_lineage(small)
    side = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    return rows.join(side, on, how)
