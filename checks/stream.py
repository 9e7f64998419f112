"""Streaming jobs run to completion over the supplied files (`availableNow`)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql
from checks.common import day, live_of, with_days
from tidemark.session import working_path
from tidemark.sources import bus, event_feed
from tidemark.sources.tables import supplied
from tidemark.streaming import bronze_landing, live_kpis


def _event_stream(spark, sf_dir):
    schema = supplied(spark, sf_dir, "events").schema
    return bus.read_files_as_stream(spark, sf_dir, schema, glob="events.parquet")


def _finish(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def kafka_source(spark, sf_dir):
    """The bus role played by a file stream: records are written as they are read."""
    path, checkpoint = working_path(spark, "bus"), working_path(spark, "bus-cp")
    stream = event_feed.envelopes_from_events(_event_stream(spark, sf_dir))
    _finish(
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    return spark.read.parquet(path).select(F.col("value").cast("string").alias("value"))


def bronze_stream(spark, sf_dir):
    path, checkpoint = working_path(spark, "landed"), working_path(spark, "landed-cp")
    stream = event_feed.envelopes_from_events(_event_stream(spark, sf_dir))
    _finish(bronze_landing.land(stream, path, checkpoint, available_now=True))
    rows = spark.read.parquet(path)
    return rows.select(
        "event_id", "source", "tenant_id", "event_type", "livemode", "created_epoch",
        "api_version", "payload", day("event_date"),
    )


ARRIVALS = 6


def _arrivals(spark, sf_dir):
    """The events as they come in seven micro-batches: each of six holds events of all days, so
    most are weeks late, and the last delivers every error event again."""
    events = supplied(spark, sf_dir, "events")
    path = working_path(spark, "arrivals")
    for k in range(ARRIVALS):
        part = events.where(F.pmod(F.xxhash64("event_id"), F.lit(ARRIVALS)) == k)
        part.write.mode("append").parquet(path)
    events.where("event_type = 'error'").write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return live_kpis.typed_events(event_feed.bronze_from_events(stream))


def _deduped(spark, sf_dir):
    path, checkpoint = working_path(spark, "deduped"), working_path(spark, "deduped-cp")
    _finish(live_kpis.start_deduped(_arrivals(spark, sf_dir), path, checkpoint))
    return path


def dedupe_stream(spark, sf_dir):
    return spark.read.parquet(_deduped(spark, sf_dir)).select(
        "event_id", "tenant_id", "event_type", F.col("amount").cast("bigint").alias("amount")
    )


def _kpi_stream(spark, sf_dir):
    path, checkpoint = working_path(spark, "kpi-stream"), working_path(spark, "kpi-stream-cp")
    _finish(live_kpis.start_daily(_arrivals(spark, sf_dir), path, checkpoint))
    return live_kpis.current_kpis(spark.read.parquet(path))


def kpi_stream(spark, sf_dir):
    return with_days(_kpi_stream(spark, sf_dir), "metric_date")


def kpi_state(spark, sf_dir):
    path, checkpoint = working_path(spark, "mrr-state"), working_path(spark, "mrr-state-cp")
    events = live_kpis.fresh_stream(spark, _deduped(spark, sf_dir))
    _finish(live_kpis.start_running_mrr(events, path, checkpoint))
    rows = live_kpis.newest_wins(
        spark.read.parquet(path), ["tenant_id", "metric_date"], "batch_id"
    )
    return rows.select("tenant_id", day("metric_date"), "mrr")


def late_data(spark, sf_dir):
    path, checkpoint = working_path(spark, "late"), working_path(spark, "late-cp")
    stream = event_feed.bronze_from_events(_event_stream(spark, sf_dir))
    _finish(live_kpis.start_late(stream, path, checkpoint, delay="30 minutes"))
    return with_days(live_kpis.late_by_day(spark.read.parquet(path)), "event_date")


def stream_batch_parity(spark, sf_dir):
    """Differences between the streamed and the batch KPIs, and how many days were compared."""
    streamed, batch = _kpi_stream(spark, sf_dir), live_of(spark, sf_dir)
    different = live_kpis.parity(streamed, batch).agg(F.count(F.lit(1)).alias("different"))
    return batch.agg(F.count(F.lit(1)).alias("days")).join(F.broadcast(different))


def stream_gold_parity(spark, sf_dir):
    """The same against gold, whose undefined rates are read as 0."""
    from checks.common import features_of

    gold = features_of(spark, sf_dir).drop("day")
    rows = live_kpis.parity(_kpi_stream(spark, sf_dir), gold)
    return with_days(rows, "metric_date")


QUERIES = {
    f.__name__: f
    for f in (
        kafka_source, bronze_stream, dedupe_stream, kpi_stream, kpi_state, late_data,
        stream_batch_parity, stream_gold_parity,
    )
}

_MD = "strftime(metric_date, '%Y-%m-%d') AS metric_date"

ORACLE = {
    "kafka_source": f"""WITH {sql.FEED}
      SELECT '{{"id":"' || event_id || '","source":"stripe","tenant_id":"' || tenant_id
        || '","event_type":"' || event_type || '","livemode":false,"created":' || created_epoch
        || ',"api_version":"2024-06-20","data":{{"object":' || payload || '}}}}' AS value
      FROM bronze""",
    "bronze_stream": f"""WITH {sql.FEED}
      SELECT event_id, 'stripe' AS source, tenant_id, event_type, false AS livemode,
        created_epoch, '2024-06-20' AS api_version, payload,
        strftime(event_date, '%Y-%m-%d') AS event_date FROM bronze""",
    "dedupe_stream": f"""WITH {sql.SILVER}
      SELECT event_id, tenant_id, event_type, amount_cents AS amount FROM silver""",
    "kpi_stream": f"WITH {sql.LIVE} SELECT * REPLACE ({_MD}) FROM live",
    "kpi_state": f"WITH {sql.LIVE} SELECT tenant_id, {_MD}, mrr FROM live",
    "late_data": f"""WITH {sql.FEED}
      SELECT strftime(event_date, '%Y-%m-%d') AS event_date, count(*) AS events
      FROM bronze WHERE ingested_at > (to_timestamp(created_epoch) AT TIME ZONE 'UTC')
        + INTERVAL 30 MINUTE
      GROUP BY 1""",
    "stream_batch_parity": f"""WITH {sql.LIVE}
      SELECT count(*) AS days, 0 AS different FROM live""",
    "stream_gold_parity": """
      SELECT '' AS tenant_id, '' AS metric_date, 0.0 AS live_mrr, 0.0 AS live_conversion_rate,
        0.0 AS live_refund_rate, 0.0 AS live_checkout_volume, 0.0 AS batch_mrr,
        0.0 AS batch_conversion_rate, 0.0 AS batch_refund_rate, 0.0 AS batch_checkout_volume
      WHERE false""",
}
