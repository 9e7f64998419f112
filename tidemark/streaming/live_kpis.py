"""Continuous KPIs: dedupe by a log of ids, daily increments, running MRR as state.

No watermark is involved: an event counts in its day whenever it comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.scalars import payload_struct
from tidemark.operators.kpis import live_contributions, live_kpis
from tidemark.session import ROCKSDB_PROVIDER, path_exists
from tidemark.sources.sinks import newest_wins, upsert_batch
from tidemark.streaming import id_log

AVAILABLE = {"availableNow": True}  # the trigger of a run that ends; a lasting one has a period


def typed_events(bronze: DataFrame) -> DataFrame:
    """Bronze rows → the columns the live path uses; events without a tenant are not counted."""
    return bronze.where(F.coalesce("tenant_id", F.lit("")) != "").select(
        "event_id",
        "tenant_id",
        "event_type",
        F.timestamp_seconds("created_epoch").alias("event_ts"),
        F.to_date(F.timestamp_seconds("created_epoch")).alias("event_date"),
        payload_struct(F.col("payload"))["amount"].alias("amount"),
    )


def keep_fresh(batch: DataFrame, table: str, batch_id: int) -> DataFrame:
    """Adds the events of a micro-batch that ``table`` does not hold yet, and returns them.

    The ids beside the table (``id_log``) say what it holds. A copy has the date of its first
    delivery, so only the dates of the batch are asked, however late it comes; nothing expires,
    and an event dated in the future pushes nothing out. A batch that was written before a
    failure is not written again; its ids are added after its rows, and again if that failed.
    """
    spark = batch.sparkSession
    path, log = f"{table}/batch_id={batch_id}", f"{table}.ids"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        known = id_log.held_ids(batch, log)
        rows = batch.dropDuplicates(["event_id"])
        if known is not None:
            rows = rows.join(known, "event_id", "left_anti")
        rows.write.mode("overwrite").partitionBy("event_date").parquet(path)
    fresh = spark.read.schema(_KEPT).parquet(path)
    id_log.add(fresh, log, batch_id)
    return fresh


_KEPT = (
    "event_id string, tenant_id string, event_type string, event_ts timestamp, amount string, "
    "event_date date"
)


def start_deduped(
    events: DataFrame, table: str, checkpoint: str, trigger: dict = AVAILABLE, then=None
) -> StreamingQuery:
    """One row per event id, over all micro-batches; ``then`` gets a batch's new rows."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        fresh = keep_fresh(batch, table, batch_id)
        if then is not None:
            then(fresh, batch_id)

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
        .trigger(**trigger)
        .start()
    )


def fresh_stream(spark: SparkSession, table: str) -> DataFrame:
    """The rows that ``start_deduped`` adds, as a stream."""
    return (
        spark.readStream.schema(_KEPT)
        .option("recursiveFileLookup", "false")
        .option("basePath", table)
        .parquet(f"{table}/batch_id=*")
    )


def daily_sums(events: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(name) for name, c in live_contributions().items()]
    return events.groupBy("tenant_id", F.col("event_date").alias("metric_date")).agg(*sums)


def start_daily(
    events: DataFrame, table: str, checkpoint: str, trigger: dict = AVAILABLE
) -> StreamingQuery:
    """Adds the daily sums of every micro-batch's new events to the log at ``table``.

    The log holds increments, one folder per batch: a late event adds to its day, and a
    repeated batch replaces its own folder. The events themselves are kept beside it.
    """
    return start_deduped(
        events,
        f"{table}.events",
        checkpoint,
        trigger,
        then=lambda fresh, batch_id: upsert_batch(daily_sums(fresh), table, batch_id),
    )


def current_kpis(increments: DataFrame) -> DataFrame:
    """Log of increments → live KPI rows; running MRR is recomputed on the small daily table."""
    names = list(live_contributions())
    daily = increments.groupBy("tenant_id", "metric_date").agg(*(F.sum(n).alias(n) for n in names))
    return live_kpis(daily)


def newcomers(increments: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenants of the stream that the tenant table does not hold yet."""
    return increments.select("tenant_id").distinct().join(tenants, "tenant_id", "left_anti")


def start_late(
    bronze: DataFrame, path: str, checkpoint: str, delay: str, trigger: dict = AVAILABLE
) -> StreamingQuery:
    """Keeps the rows that arrive more than ``delay`` after their event time, for a report: the
    live path counts them in their day like any other."""
    event_ts = F.timestamp_seconds("created_epoch")
    late = bronze.where(F.col("ingested_at") > event_ts + F.expr(f"interval {delay}"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(
            batch.select("event_id", "tenant_id", "event_date", "created_epoch", "ingested_at"),
            path,
            batch_id,
        )

    return (
        late.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
        .trigger(**trigger)
        .start()
    )


def late_by_day(late: DataFrame) -> DataFrame:
    """Late rows per day over all micro-batches of ``start_late``."""
    return late.groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))


# --- Running MRR as state -----------------------------------------------------------------

STATE_OUTPUT = "tenant_id string, metric_date date, mrr double"
_PARTIAL = "tenant_id string, metric_date date, delta bigint"


def _sum_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield batch.groupby(["tenant_id", "metric_date"], as_index=False)["delta"].sum()


def mrr_deltas(events: DataFrame) -> DataFrame:
    """Per-task partial sums of the MRR movement: a hot tenant sends a few rows per Arrow
    batch and day to its state task, not its events."""
    delta = live_contributions()["mrr_delta_cents"]
    return events.select(
        "tenant_id", F.col("event_date").alias("metric_date"), delta.alias("delta")
    ).mapInPandas(_sum_batches, _PARTIAL)


class RunningMrr(StatefulProcessor):
    """Keeps each tenant's daily MRR movement and emits the running total of changed days."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._days = handle.getMapState("days", "day date", "delta bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changed = None
        for batch in rows:
            for day, delta in batch.groupby("metric_date")["delta"].sum().items():
                known = self._days.containsKey((day,))
                before = self._days.getValue((day,))[0] if known else 0
                self._days.updateValue((day,), (before + int(delta),))
                changed = day if changed is None else min(changed, day)
        if changed is None:
            return
        # One tenant's days: bounded by the calendar.
        days = sorted((k[0], v[0]) for k, v in self._days.iterator())
        total, out = 0, []
        for day, delta in days:
            total += delta
            if day >= changed:
                out.append((key[0], day, round(total / 100.0, 2)))
        yield pd.DataFrame(out, columns=["tenant_id", "metric_date", "mrr"])

    def close(self) -> None:
        pass


def start_running_mrr(
    events: DataFrame, table: str, checkpoint: str, trigger: dict = AVAILABLE
) -> StreamingQuery:
    """Deduped events (``fresh_stream``) → running MRR rows in the change log at ``table``; totals
    live in state.

    Arbitrary state needs the RocksDB state store.
    """
    events.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER
    )
    running = (
        mrr_deltas(events)
        .groupBy("tenant_id")
        .transformWithStateInPandas(
            statefulProcessor=RunningMrr(),
            outputStructType=STATE_OUTPUT,
            outputMode="append",
            timeMode="None",
        )
    )

    def upsert(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, table, batch_id)

    return (
        running.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(upsert)
        .trigger(**trigger)
        .start()
    )


def parity(live: DataFrame, batch: DataFrame) -> DataFrame:
    """Tenant-days on which the live and the batch KPIs differ, missing ones included."""
    names = ["mrr", "conversion_rate", "refund_rate", "checkout_volume"]
    a, b = live.alias("a"), batch.alias("b")
    on = (F.col("a.tenant_id") == F.col("b.tenant_id")) & (
        F.col("a.metric_date") == F.col("b.metric_date")
    )
    differs = F.lit(False)
    for n in names:
        differs = differs | ~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
    return (
        a.join(b, on, "full_outer")
        .where(differs)
        .select(
            F.coalesce("a.tenant_id", "b.tenant_id").alias("tenant_id"),
            F.coalesce("a.metric_date", "b.metric_date").alias("metric_date"),
            *[F.col(f"a.{n}").alias(f"live_{n}") for n in names],
            *[F.col(f"b.{n}").alias(f"batch_{n}") for n in names],
        )
    )
