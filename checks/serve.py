"""Serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql
from checks.common import features_of, live_of, rule_records_of, stamp, with_days
from tidemark.operators import grounding, serving
from tidemark.sources import event_feed
from tidemark.sources.tables import supplied


def _alerts(spark, sf_dir, threshold=0.9):
    """Rule-typed records with a status by confidence; their score stands in for faithfulness."""
    status = grounding.alert_status(F.col("type_confidence"), F.col("anomaly_score") >= 0.95)
    return (
        rule_records_of(spark, sf_dir, threshold)
        .withColumn("status", status)
        .withColumn("faithfulness", F.col("anomaly_score"))
    )


def top_anomalies(spark, sf_dir):
    rows = serving.top_anomalies(_alerts(spark, sf_dir))
    return rows.select("tenant_id", "metric_date", "anomaly_type", "anomaly_score", "status")


def kpi_history(spark, sf_dir):
    return with_days(serving.kpi_history(live_of(spark, sf_dir), "acct_1", 20), "metric_date")


def kpi_history_all(spark, sf_dir):
    return with_days(serving.kpi_history_all(live_of(spark, sf_dir), 7), "metric_date")


def tenant_list(spark, sf_dir):
    customers = supplied(spark, sf_dir, "customer").select(
        F.concat(F.lit("acct_"), F.col("c_custkey").cast("string")).alias("tenant_id"),
        F.col("c_name").alias("name"),
    )
    return serving.tenant_list(customers)


def stat_tiles(spark, sf_dir):
    rows = serving.stat_tiles(_alerts(spark, sf_dir))
    return rows.withColumn("avg_faithfulness", F.round("avg_faithfulness", 9))


def driver_trend(spark, sf_dir):
    return with_days(
        serving.driver_trend(_alerts(spark, sf_dir), features_of(spark, sf_dir).drop("day")),
        "metric_date",
    )


def request_rate(spark, sf_dir):
    rows = serving.request_rate(event_feed.request_log(spark, sf_dir))
    return rows.select(stamp("window_start"), "route", F.round("per_second", 6).alias("per_second"))


def latency_quantiles(spark, sf_dir):
    rows = serving.latency_quantiles(event_feed.request_log(spark, sf_dir))
    return rows.select(
        stamp("window_start"), "requests",
        *[F.round(c, 9).alias(c) for c in ("p50", "p95", "p99")],
    )


def error_rate(spark, sf_dir):
    rows = serving.error_rate(event_feed.request_log(spark, sf_dir))
    return rows.select(stamp("window_start"), F.round("per_second", 9).alias("per_second"))


def hit_ratio(spark, sf_dir):
    """Cheap requests count as cache hits."""
    log = event_feed.request_log(spark, sf_dir).withColumn("hit", F.col("seconds") < 0.25)
    rows = serving.hit_ratio(log)
    return rows.select(stamp("window_start"), F.round("ratio", 9).alias("ratio"))


def source_throughput(spark, sf_dir):
    log = event_feed.request_log(spark, sf_dir).withColumnRenamed("route", "source")
    rows = serving.source_throughput(log)
    return rows.select(
        stamp("window_start"), "source", F.round("per_second", 6).alias("per_second")
    )


def rate_limit(spark, sf_dir):
    rows = serving.rate_limit(event_feed.request_log(spark, sf_dir), limit=1)
    return rows.select("client", stamp("window_start"), "requests", "rejected")


QUERIES = {
    f.__name__: f
    for f in (
        top_anomalies, kpi_history, kpi_history_all, tenant_list, stat_tiles, driver_trend,
        request_rate, latency_quantiles, error_rate, hit_ratio, source_throughput, rate_limit,
    )
}

_ALERTS = sql.RECORDS + """,
alerts AS (
  SELECT *, CASE WHEN type_confidence < 0.6 THEN 'held_for_review'
    WHEN anomaly_score < 0.95 THEN 'held_low_faithfulness' ELSE 'ready' END AS status,
    anomaly_score AS faithfulness
  FROM typed_records WHERE anomaly_score >= 0.9
)"""

_LOG = """log AS (SELECT ts, event_type AS route, user_id AS client,
  CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, value / 200.0 AS seconds
  FROM events)"""


def _start(width: str) -> str:
    return f"strftime(time_bucket(INTERVAL '{width}', ts), '%Y-%m-%d %H:%M:%S') AS window_start"


_BOUNDS = ["0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1.0", "2.5"]


def _quantile(q: str) -> str:
    cases = []
    for i, bound in enumerate(_BOUNDS):
        low = _BOUNDS[i - 1] if i else "0.0"
        under = f"le{i - 1}" if i else "0"
        cases.append(
            f"WHEN le{i} >= {q} * requests THEN {low}::DOUBLE + ({bound}::DOUBLE - {low}::DOUBLE) "
            f"* (({q}::DOUBLE * requests - {under}) / CAST(le{i} - {under} AS DOUBLE))"
        )
    return f"round(CASE {' '.join(cases)} ELSE 2.5 END, 9)"


ORACLE = {
    "top_anomalies": f"""WITH {_ALERTS}
      SELECT tenant_id, metric_date, anomaly_type, anomaly_score, status FROM alerts
      ORDER BY anomaly_score DESC, tenant_id, metric_date LIMIT 50""",
    "kpi_history": f"""WITH {sql.LIVE}
      SELECT * REPLACE (strftime(metric_date, '%Y-%m-%d') AS metric_date) FROM (
        SELECT * FROM live WHERE tenant_id = 'acct_1' ORDER BY metric_date DESC LIMIT 20)""",
    "kpi_history_all": f"""WITH {sql.LIVE}
      SELECT * REPLACE (strftime(metric_date, '%Y-%m-%d') AS metric_date) FROM live
      QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY live.metric_date DESC) <= 7""",
    "tenant_list": "SELECT 'acct_' || c_custkey AS tenant_id, c_name AS name FROM customer",
    "stat_tiles": f"""WITH {_ALERTS}
      SELECT count(*) AS total, count(*) FILTER (status = 'ready') AS ready,
        count(*) FILTER (status <> 'ready') AS held,
        round(coalesce(avg(faithfulness), 0.0), 9) AS avg_faithfulness,
        count(DISTINCT tenant_id) AS tenants FROM alerts""",
    "driver_trend": f"""WITH {_ALERTS}
      SELECT a.tenant_id, a.metric_date AS anomaly_date, m1 AS driver,
        strftime(f.metric_date, '%Y-%m-%d') AS metric_date,
        CASE m1 WHEN 'mrr' THEN f.mrr WHEN 'conversion_rate' THEN f.conversion_rate
          WHEN 'refund_rate' THEN f.refund_rate ELSE f.checkout_volume END AS value
      FROM alerts a JOIN features f USING (tenant_id)""",
    "request_rate": f"""WITH {_LOG}
      SELECT {_start("1 minute")}, route, round(count(*) / 60.0::DOUBLE, 6) AS per_second
      FROM log GROUP BY 1, 2""",
    "latency_quantiles": f"""WITH {_LOG},
      buckets AS (
        SELECT {_start("5 minutes")}, count(*) AS requests,
          {", ".join(f"count(*) FILTER (seconds <= {b}::DOUBLE) AS le{i}" for i, b in enumerate(_BOUNDS))}
        FROM log GROUP BY 1
      )
      SELECT window_start, requests, {_quantile("0.5")} AS p50, {_quantile("0.95")} AS p95,
        {_quantile("0.99")} AS p99 FROM buckets""",
    "error_rate": f"""WITH {_LOG}
      SELECT {_start("5 minutes")},
        round(count(*) FILTER (status LIKE '5%') / 300.0::DOUBLE, 9) AS per_second
      FROM log GROUP BY 1""",
    "hit_ratio": f"""WITH {_LOG}
      SELECT {_start("5 minutes")}, round(count(*) FILTER (seconds < 0.25)
        / CAST(greatest(count(*), 1) AS DOUBLE), 9) AS ratio FROM log GROUP BY 1""",
    "source_throughput": f"""WITH {_LOG}
      SELECT {_start("1 minute")}, route AS source, round(count(*) / 60.0::DOUBLE, 6) AS per_second
      FROM log GROUP BY 1, 2""",
    "rate_limit": f"""WITH {_LOG}
      SELECT client, {_start("1 minute")}, count(*) AS requests, greatest(count(*) - 1, 0) AS rejected
      FROM log GROUP BY 1, 2""",
}
