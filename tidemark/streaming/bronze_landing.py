"""Bus records → bronze files, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ingest import to_bronze
from tidemark.sources.bus import TRIGGER_INTERVAL

TENANT_GROUPS = 16  # tasks, and files, that a day's tenants are dealt to in a micro-batch


def land(
    raw: DataFrame,
    path: str,
    checkpoint: str,
    trigger_interval: str = TRIGGER_INTERVAL,
    available_now: bool = False,
    layout: tuple[str, ...] = ("event_date",),
) -> StreamingQuery:
    """Starts the landing query. The file sink commits each micro-batch atomically.

    Files are laid out by day, so a micro-batch writes as many as it has days times
    ``TENANT_GROUPS`` at most, whatever the number of tenants; a tenant is in one file of a day and
    micro-batch. With few tenants, ``layout=("tenant_id", "event_date")`` writes a folder for each of
    theirs and days. All-null rows of undecodable records land too, in the null partition.
    """
    rows = to_bronze(raw)
    group = F.pmod(F.xxhash64("tenant_id"), F.lit(TENANT_GROUPS))
    writer = (
        rows.repartition(*layout, *([] if "tenant_id" in layout else [group]))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .partitionBy(*layout)
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=trigger_interval).start()
