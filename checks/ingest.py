"""Sources, ingest and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql
from checks.common import day, features_of, gold_of, live_of, rule_records_of, stamp, with_days
from tidemark.functions.scalars import topic_for
from tidemark.operators import ingest, labels
from tidemark.session import working_path
from tidemark.sources import bus, event_feed, sinks, tables


def envelope_normalize(spark, sf_dir):
    return ingest.envelopes(ingest.parse_webhooks(event_feed.webhooks(spark, sf_dir)))


def tenant_route(spark, sf_dir):
    return envelope_normalize(spark, sf_dir).select(
        F.col("id").alias("event_id"), topic_for(F.col("tenant_id")).alias("topic")
    )


def ingest_outcome(spark, sf_dir):
    return ingest.outcome_counts(ingest.parse_webhooks(event_feed.webhooks(spark, sf_dir)))


def ingest_quarantine(spark, sf_dir):
    return ingest.quarantine(ingest.parse_webhooks(event_feed.webhooks(spark, sf_dir)))


def kafka_records(spark, sf_dir):
    return bus.bus_records(envelope_normalize(spark, sf_dir))


def to_bronze(spark, sf_dir):
    rows = ingest.to_bronze(event_feed.envelopes(spark, sf_dir)).drop("ingested_at")
    return with_days(rows, "event_date")


def bronze_sink(spark, sf_dir):
    path = working_path(spark, "bronze")
    sinks.write_bronze(event_feed.bronze(spark, sf_dir), path)
    return (
        spark.read.parquet(path)
        .groupBy("tenant_id", "event_date")
        .agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("ids"))
        .select("tenant_id", day("event_date"), "events", "ids")
    )


def bronze_csv_scan(spark, sf_dir):
    path = working_path(spark, "bronze-csv")
    (
        event_feed.bronze(spark, sf_dir)
        .drop("event_date")
        .write.option("escape", '"')
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .csv(path, header=True)
    )
    rows = tables.read_bronze_csv(spark, path)
    return rows.select(
        "event_id", "source", "tenant_id", "event_type", "livemode", "created_epoch",
        "api_version", "payload", stamp("ingested_at"),
    )


def gold_scan(spark, sf_dir):
    path = working_path(spark, "gold")
    sinks.write_gold(gold_of(spark, sf_dir), path)
    rows = tables.read_gold(spark, path).orderBy("tenant_id", "metric_date")
    return with_days(rows, "metric_date")


def kpi_upsert(spark, sf_dir):
    """A first load, then an update of the days with a refund: newest row per key wins."""
    path = working_path(spark, "kpi-log")
    live = live_of(spark, sf_dir)
    sinks.upsert_batch(live, path, 0)
    changed = live.where("refund_rate > 0").withColumn("checkout_volume", F.lit(-1.0))
    sinks.upsert_batch(changed, path, 1)
    keys = ["tenant_id", "metric_date"]
    return with_days(sinks.read_upserted(spark, path, keys), "metric_date")


def tenant_anti_insert(spark, sf_dir):
    """Known are the tenants with a refund on the first day; all others are new."""
    live = live_of(spark, sf_dir)
    known = live.where("metric_date = date '2024-01-01' AND refund_rate > 0")
    return sinks.new_tenants(known.select("tenant_id").distinct(), live)


def anomaly_upsert(spark, sf_dir):
    """The 0.9 log takes the 0.95 run: an existing key refreshes its status only."""
    keys = ["tenant_id", "metric_date", "anomaly_type"]
    columns = [*keys, "anomaly_score", "status", "detected_at"]
    current = (
        rule_records_of(spark, sf_dir, 0.9)
        .withColumn("status", F.lit("held_for_review"))
        .withColumn("detected_at", F.lit("first run"))
        .select(*columns)
    )
    changes = (
        rule_records_of(spark, sf_dir, 0.95)
        .withColumn("status", F.lit("ready"))
        .withColumn("detected_at", F.lit("second run"))
        .withColumn("anomaly_score", F.lit(1.5))
        .select(*columns)
    )
    path = working_path(spark, "anomaly-log")
    sinks.upsert_batch(current, path, 0, "metric_date")
    sinks.upsert_columns(changes, path, 1, keys, ["status", "detected_at"], "metric_date")
    return sinks.read_upserted(spark, path, keys)


def anomaly_bundle(spark, sf_dir):
    records = rule_records_of(spark, sf_dir).select(
        "tenant_id",
        "metric_date",
        "anomaly_type",
        F.round("anomaly_score", 4).alias("anomaly_score"),
        "type_confidence",
        "top_contributors",
        F.struct(*[F.col("metrics")[m].alias(m) for m in sql.METRICS]).alias("metrics"),
        "description",
    )
    return sinks.bundle_json(records)


def _points(spark, sf_dir):
    return tables.supplied(spark, sf_dir, "events").select(
        F.col("event_type").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )


def _windows(points):
    """Half an hour around every point above 300."""
    half_hour = F.expr("interval 30 minutes")
    return points.where("value > 300").select(
        "stream", (F.col("ts") - half_hour).alias("start"), (F.col("ts") + half_hour).alias("end")
    )


def labelled_series_scan(spark, sf_dir):
    """Writes the streams as CSV files and the windows as JSON lines, reads both back."""
    root = working_path(spark, "series")
    points = _points(spark, sf_dir)
    form = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    points.select(
        "stream", F.date_format("ts", form).alias("timestamp"), "value"
    ).repartition("stream", F.pmod(F.xxhash64("ts"), F.lit(8))).write.partitionBy("stream").csv(
        f"{root}/data", header=True
    )
    _windows(points).select(
        F.to_json(
            F.create_map(
                F.col("stream"),
                F.array(F.array(F.date_format("start", form), F.date_format("end", form))),
            )
        ).alias("value")
    ).write.text(f"{root}/labels")
    series = (
        spark.read.schema("timestamp timestamp, value double, stream string")
        .csv(f"{root}/data", header=True)
        .withColumnRenamed("timestamp", "ts")
    )
    windows = tables.read_label_windows(spark, f"{root}/labels", whole_file=False)
    labelled = labels.interval_label(series, windows)
    return labelled.groupBy("stream", "is_anomaly").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 2).alias("value")
    )


def interval_label(spark, sf_dir):
    points = _points(spark, sf_dir)
    return labels.interval_label(points, _windows(points)).select(
        "stream", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value",
        "is_anomaly",
    )


def adapt_features(spark, sf_dir):
    return with_days(features_of(spark, sf_dir), "metric_date")


QUERIES = {
    f.__name__: f
    for f in (
        envelope_normalize, tenant_route, ingest_outcome, ingest_quarantine, kafka_records,
        to_bronze, bronze_sink, bronze_csv_scan, gold_scan, kpi_upsert, tenant_anti_insert,
        anomaly_upsert, anomaly_bundle, labelled_series_scan, interval_label, adapt_features,
    )
}

_ACCEPTED = sql.FEED + """,
bodies AS (
  SELECT event_id, event_type, created_epoch, payload, delivery,
    CASE WHEN event_type <> 'checkout.session.expired' THEN tenant_id END AS tenant_id
  FROM (SELECT *, 0 AS delivery FROM feed
        UNION ALL SELECT *, 1 AS delivery FROM feed WHERE raw_type = 'error')
),
accepted AS (
  SELECT event_id AS id, 'stripe' AS source, tenant_id, event_type, false AS livemode,
    created_epoch AS created, '2024-06-20' AS api_version, '{"object":' || payload || '}' AS data
  FROM bodies WHERE event_type <> 'checkout.session.completed'
)"""

_LABELLED = """points AS (SELECT event_type AS stream, ts, value FROM events),
windows AS (
  SELECT stream, ts - INTERVAL 30 MINUTE AS lo, ts + INTERVAL 30 MINUTE AS hi
  FROM points WHERE value > 300
),
labelled AS (
  SELECT stream, ts, value, CAST(EXISTS (
    SELECT 1 FROM windows w WHERE w.stream = p.stream AND p.ts BETWEEN w.lo AND w.hi
  ) AS INTEGER) AS is_anomaly FROM points p
)"""

ORACLE = {
    "envelope_normalize": f"WITH {_ACCEPTED} SELECT * FROM accepted",
    "tenant_route": f"""WITH {_ACCEPTED}
      SELECT id AS event_id, 'stripe.events.' || coalesce(tenant_id, 'unknown') AS topic
      FROM accepted""",
    "ingest_outcome": f"""WITH {_ACCEPTED}
      SELECT 'stripe' AS source, CASE WHEN event_type = 'checkout.session.completed'
        THEN 'rejected_payload' ELSE 'accepted' END AS outcome, count(*) AS events
      FROM bodies GROUP BY 1, 2""",
    "ingest_quarantine": f"""WITH {_ACCEPTED}
      SELECT 'stripe' AS source, 'rejected_payload' AS outcome,
        '{{"id":"' || event_id || '","object":"event","type":"' || event_type
        || '","account":"' || tenant_id || '","created":' || created_epoch AS value
      FROM bodies WHERE event_type = 'checkout.session.completed'""",
    "kafka_records": f"""WITH {_ACCEPTED}
      SELECT 'stripe.events.' || coalesce(tenant_id, 'unknown') AS topic, tenant_id AS key,
        '{{"id":"' || id || '","source":"stripe","tenant_id":'
        || coalesce('"' || tenant_id || '"', 'null') || ',"event_type":"' || event_type
        || '","livemode":false,"created":' || created || ',"api_version":"2024-06-20","data":'
        || data || '}}' AS value
      FROM accepted""",
    "to_bronze": f"""WITH {sql.FEED}
      SELECT event_id, 'stripe' AS source, tenant_id, event_type, false AS livemode,
        created_epoch, '2024-06-20' AS api_version, payload,
        strftime(event_date, '%Y-%m-%d') AS event_date
      FROM bronze""",
    "bronze_sink": f"""WITH {sql.FEED}
      SELECT tenant_id, strftime(event_date, '%Y-%m-%d') AS event_date, count(*) AS events,
        count(DISTINCT event_id) AS ids
      FROM bronze GROUP BY 1, 2""",
    "bronze_csv_scan": f"""WITH {sql.FEED}
      SELECT event_id, 'stripe' AS source, tenant_id, event_type, false AS livemode,
        created_epoch, '2024-06-20' AS api_version, payload,
        strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS ingested_at
      FROM bronze""",
    "gold_scan": f"""WITH {sql.GOLD}
      SELECT * REPLACE (strftime(metric_date, '%Y-%m-%d') AS metric_date) FROM gold""",
    "kpi_upsert": f"""WITH {sql.LIVE}
      SELECT * REPLACE (strftime(metric_date, '%Y-%m-%d') AS metric_date,
        CASE WHEN refund_rate > 0 THEN -1.0::DOUBLE ELSE checkout_volume END AS checkout_volume)
      FROM live""",
    "tenant_anti_insert": f"""WITH {sql.LIVE}
      SELECT DISTINCT tenant_id FROM live WHERE tenant_id NOT IN
        (SELECT tenant_id FROM live WHERE metric_date = DATE '2024-01-01' AND refund_rate > 0)""",
    "anomaly_upsert": f"""WITH {sql.RECORDS}
      SELECT tenant_id, metric_date, anomaly_type, anomaly_score,
        CASE WHEN anomaly_score >= 0.95 THEN 'ready' ELSE 'held_for_review' END AS status,
        CASE WHEN anomaly_score >= 0.95 THEN 'second run' ELSE 'first run' END AS detected_at
      FROM typed_records WHERE anomaly_score >= 0.9""",
    "anomaly_bundle": f"""WITH {sql.RECORDS}
      SELECT CAST(to_json({{
        'tenant_id': tenant_id, 'metric_date': metric_date, 'anomaly_type': anomaly_type,
        'anomaly_score': round(anomaly_score, 4), 'type_confidence': type_confidence,
        'top_contributors': [{{'metric': m1, 'sd': s1}}, {{'metric': m2, 'sd': s2}},
                             {{'metric': m3, 'sd': s3}}],
        'metrics': {{{", ".join(f"'{m}': {m}" for m in sql.METRICS)}}},
        'description': description}}) AS VARCHAR) AS value
      FROM flagged""",
    "labelled_series_scan": f"""WITH {_LABELLED}
      SELECT stream, is_anomaly, count(*) AS points, round(sum(value), 2) AS value
      FROM labelled GROUP BY 1, 2""",
    "interval_label": f"""WITH {_LABELLED}
      SELECT stream, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value, is_anomaly
      FROM labelled""",
    "adapt_features": f"""WITH {sql.FEATURES}
      SELECT * REPLACE (strftime(metric_date, '%Y-%m-%d') AS metric_date) FROM features""",
}
