"""Scalar functions, silver, KPIs and quality gates."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from checks import sql
from checks.common import daily_of, day, gold_of, live_of, rule_records_of, silver_of, with_days
from tidemark.functions import scalars, text
from tidemark.operators import kpis, quality, silver
from tidemark.plans import incremental, medallion
from tidemark.schemas import CHARGE_REFUNDED, INVOICE_FAILED
from tidemark.session import working_path
from tidemark.sources import event_feed
from tidemark.sources.tables import supplied


def json_fields(spark, sf_dir):
    p = scalars.payload_struct(F.col("payload"))
    return event_feed.bronze(spark, sf_dir).select("event_id", p.alias("p")).select(
        "event_id", *[F.col(f"p.{c}").alias(c) for c in
                      ("id", "customer", "subscription", "status", "currency", "amount")]
    )


def epoch_to_ts(spark, sf_dir):
    """Both forms of `created`: seconds for odd event types, ISO text for the others."""
    rows = event_feed.bronze(spark, sf_dir)
    iso = F.date_format(F.timestamp_seconds("created_epoch"), "yyyy-MM-dd'T'HH:mm:ss")
    created = F.when(F.col("event_type").like("checkout%"), iso).otherwise(
        F.col("created_epoch").cast("string")
    )
    return rows.select(
        "event_id",
        F.date_format(scalars.epoch_ts(F.col("created_epoch")), "yyyy-MM-dd HH:mm:ss").alias(
            "event_ts"
        ),
        F.date_format(scalars.flexible_date(created), "yyyy-MM-dd").alias("event_date"),
    )


def amount_parse(spark, sf_dir):
    """Amounts as text; those of refunds are damaged and those of failures missing."""
    amount = scalars.payload_struct(F.col("payload"))["amount"]
    damaged = (
        F.when(F.col("event_type") == "charge.refunded", F.concat(amount, F.lit("x")))
        .when(F.col("event_type") == "invoice.payment_failed", F.lit(None).cast("string"))
        .otherwise(amount)
    )
    rows = event_feed.bronze(spark, sf_dir).select("event_id", damaged.alias("raw"))
    return rows.select(
        "event_id",
        scalars.strict_cents(F.col("raw")).alias("strict_cents"),
        scalars.live_cents(F.col("raw")).alias("live_cents"),
    )


def metric_contributions(spark, sf_dir):
    return with_days(silver.metric_events(silver_of(spark, sf_dir)).drop("event_ts"), "event_date")


def cents_to_dollars(spark, sf_dir):
    return silver_of(spark, sf_dir).select(
        "event_id", scalars.dollars(F.col("amount_cents")).alias("amount")
    )


def safe_ratio(spark, sf_dir):
    n, d = F.col("refund_cents"), F.col("gross_revenue_cents")
    return daily_of(spark, sf_dir).select(
        "tenant_id", day("metric_date"),
        scalars.safe_ratio(n, d).alias("gold_rate"), scalars.safe_ratio(n, d, 0.0).alias("live_rate"),
    )


def dedupe_first(spark, sf_dir):
    order = [F.col("ingested_at"), F.xxhash64("payload")]
    rows = silver.first_delivery(event_feed.bronze(spark, sf_dir), "event_id", order)
    return rows.select(
        "event_id", "tenant_id", "event_type",
        F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"),
    )


def silver_events(spark, sf_dir):
    rows = silver_of(spark, sf_dir).drop("livemode")
    return with_days(
        rows.withColumn("event_ts", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss")), "event_date"
    )


def daily_kpi(spark, sf_dir):
    return with_days(daily_of(spark, sf_dir), "metric_date")


def live_daily_kpi(spark, sf_dir):
    return with_days(live_of(spark, sf_dir), "metric_date")


def running_mrr(spark, sf_dir):
    return kpis.running_totals(daily_of(spark, sf_dir)).select(
        "tenant_id", day("metric_date"), "mrr_cents_cum"
    )


def active_subs(spark, sf_dir):
    return kpis.running_totals(daily_of(spark, sf_dir)).select(
        "tenant_id", day("metric_date"), "active_subscriptions"
    )


def churn_rate(spark, sf_dir):
    return kpis.running_totals(daily_of(spark, sf_dir)).select(
        "tenant_id", day("metric_date"), kpis.churn_rate().alias("churn_rate")
    )


def gold_kpis(spark, sf_dir):
    return with_days(gold_of(spark, sf_dir), "metric_date")


def incremental_gold(spark, sf_dir):
    """Gold kept up by three batches: most events, a quarter that comes late for all days, and
    error events delivered once more; read as two ranges of days."""
    bronze, root = event_feed.bronze(spark, sf_dir), working_path(spark, "incremental-gold")
    late = F.pmod(F.xxhash64("event_id"), F.lit(4)) == 3
    again = F.col("event_type").isin(CHARGE_REFUNDED, INVOICE_FAILED)
    for batch, rows in enumerate((bronze.where(~late), bronze.where(late), bronze.where(again))):
        incremental.apply_batch(spark, rows, root, batch)
    middle = bronze.agg(F.date_sub(F.max("event_date"), 9)).first()[0]
    before = incremental.read_gold(spark, root, last=middle - datetime.timedelta(days=1))
    return with_days(before.unionByName(incremental.read_gold(spark, root, middle)), "metric_date")


def golden_diff(spark, sf_dir):
    """Gold held against the live KPIs: they differ where gold leaves a rate undefined."""
    columns = ["mrr", "conversion_rate", "refund_rate"]
    rows = kpis.mismatches(
        live_of(spark, sf_dir), gold_of(spark, sf_dir), ["tenant_id", "metric_date"], columns
    )
    return with_days(rows, "metric_date")


def grain_unique(spark, sf_dir):
    """The same check on gold (no rows) and on bronze event ids (the re-delivered ones)."""
    gold = kpis.duplicated_grain(gold_of(spark, sf_dir), ["tenant_id", "metric_date"])
    bronze = kpis.duplicated_grain(event_feed.bronze(spark, sf_dir), ["event_id"])
    return gold.select(F.lit("gold").alias("grain"), F.col("tenant_id").alias("key"), "n").union(
        bronze.select(F.lit("bronze"), "event_id", "n")
    )


def _bronze_report(spark, sf_dir):
    rows = event_feed.bronze(spark, sf_dir)
    # Payments that failed lost their type, so one gate has something to find.
    damaged = rows.withColumn(
        "event_type", F.when(F.col("event_type") != "invoice.payment_failed", F.col("event_type"))
    )
    return quality.report(damaged, "bronze", quality.bronze_checks(damaged))


def _gold_report(spark, sf_dir):
    gold = gold_of(spark, sf_dir)
    return quality.report(gold, "gold", quality.gold_checks(gold))


def _only(report, expectation):
    return report.where(F.col("expectation") == expectation)


def expect_row_count(spark, sf_dir):
    return _only(_gold_report(spark, sf_dir), "row_count_at_least_1")


def expect_columns(spark, sf_dir):
    """Gold has its columns; a bronze table without payload lacks one."""
    cut = event_feed.bronze(spark, sf_dir).drop("payload")
    bronze = quality.report(cut, "bronze", quality.bronze_checks(cut))
    return _only(_gold_report(spark, sf_dir).union(bronze), "column_exists")


def expect_not_null(spark, sf_dir):
    return _only(_bronze_report(spark, sf_dir), "not_null")


def expect_between(spark, sf_dir):
    return _only(_gold_report(spark, sf_dir), "between")


def expect_unique(spark, sf_dir):
    """Event ids per table: how many occur more than once."""
    def line(name, rows):
        repeated = kpis.duplicated_grain(rows.select("event_id"), ["event_id"])
        return repeated.agg(F.count(F.lit(1)).alias("unexpected")).select(
            F.lit(name).alias("suite"), "unexpected", (F.col("unexpected") == 0).alias("success")
        )

    return line("silver", silver_of(spark, sf_dir)).union(
        line("bronze", event_feed.bronze(spark, sf_dir))
    )


def suite_report(spark, sf_dir):
    return quality.suite_summary(_bronze_report(spark, sf_dir).union(_gold_report(spark, sf_dir)))


def gated_run(spark, sf_dir):
    """Writes gold, then gates bronze, silver and the written gold; here without raising."""
    path = working_path(spark, "gated-gold")
    return medallion.gated_run(event_feed.bronze(spark, sf_dir), path, enforce=False)


def label_normalise(spark, sf_dir):
    """Provider event types read as free-text labels."""
    raw = F.concat_ws(" ", F.initcap(F.translate("event_type", ".", " ")), F.col("status"))
    words = (
        F.when(F.col("status") == "open", F.lit(" Payment_Failure "))
        .when(F.col("event_type").like("checkout%"), F.concat(F.lit("Seasonal  "), raw))
        .when(F.col("event_type").like("customer%"), F.concat(F.lit("Spike of churn "), raw))
        .otherwise(F.concat(F.lit("effect "), raw))
    )
    return silver_of(spark, sf_dir).select("event_id", scalars.nearest_label(words).alias("label"))


def severity_band(spark, sf_dir):
    return rule_records_of(spark, sf_dir, 0.0).select(
        "tenant_id", "metric_date",
        scalars.severity_band(F.col("anomaly_score")).alias("severity"),
        scalars.faithfulness_band(F.col("anomaly_score")).alias("faithfulness"),
    )


def metric_format(spark, sf_dir):
    rows = rule_records_of(spark, sf_dir, 0.0)
    return rows.select(
        "tenant_id", "metric_date", text.type_label(F.col("anomaly_type")).alias("type_label"),
        text.type_icon(F.col("anomaly_type")).alias("type_icon"),
        *[text.metric_text(F.lit(m), F.col("metrics")[m]).alias(m) for m in sql.METRICS],
    )


def tokenize(spark, sf_dir):
    return supplied(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(scalars.tokens(F.col("text")), " ").alias("tokens")
    )


def extract_numbers(spark, sf_dir):
    """Numbers in the whole text of every document and page."""
    docs = supplied(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"
    )
    pages = supplied(spark, sf_dir, "pages").select(
        F.lit("page"), F.col("page_id"), F.col("html").alias("text")
    )
    found = docs.union(pages).withColumn("found", scalars.numbers(F.col("text")))
    return found.select(
        "kind", "id", F.size("found").cast("bigint").alias("n"),
        F.array_min("found").alias("least"), F.array_max("found").alias("largest"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        json_fields, epoch_to_ts, amount_parse, metric_contributions, cents_to_dollars, safe_ratio,
        dedupe_first, silver_events, daily_kpi, live_daily_kpi, running_mrr, active_subs,
        churn_rate, gold_kpis, incremental_gold, golden_diff, grain_unique, expect_row_count, expect_columns,
        expect_not_null, expect_between, expect_unique, suite_report, gated_run, label_normalise,
        severity_band, metric_format, tokenize, extract_numbers,
    )
}

_MD = "strftime(metric_date, '%Y-%m-%d') AS metric_date"

_REPORTS = sql.GOLD + """,
damaged AS (
  SELECT * REPLACE (CASE WHEN event_type <> 'invoice.payment_failed' THEN event_type END
    AS event_type) FROM bronze
),
b AS (SELECT count(*) AS n, count(*) FILTER (event_type IS NULL) AS no_type FROM damaged),
g AS (
  SELECT count(*) AS n,
    count(*) FILTER (active_subscriptions < 0) AS active,
    count(*) FILTER (churn_rate < 0 OR churn_rate > 1) AS churn,
    count(*) FILTER (refund_rate < 0 OR refund_rate > 1) AS refund,
    count(*) FILTER (payment_failure_rate < 0 OR payment_failure_rate > 1) AS fail,
    count(*) FILTER (conversion_rate < 0 OR conversion_rate > 1) AS conv
  FROM gold
),
lines AS (
  SELECT 'bronze' AS suite, unnest(['row_count_at_least_1',
      'column_exists', 'column_exists', 'column_exists', 'column_exists',
      'not_null', 'not_null', 'not_null']) AS expectation,
    unnest(['*', 'event_id', 'tenant_id', 'event_type', 'payload',
      'event_id', 'tenant_id', 'event_type']) AS "column",
    n AS rows, unnest([0, 0, 0, 0, 0, 0, 0, no_type]) AS unexpected FROM b
  UNION ALL
  SELECT 'gold', unnest(['row_count_at_least_1',
      'column_exists', 'column_exists', 'column_exists', 'column_exists',
      'not_null', 'not_null', 'not_null', 'between', 'between', 'between', 'between', 'between']),
    unnest(['*', 'tenant_id', 'metric_date', 'mrr', 'active_subscriptions',
      'tenant_id', 'metric_date', 'mrr', 'active_subscriptions', 'churn_rate', 'refund_rate',
      'payment_failure_rate', 'conversion_rate']),
    n, unnest([0, 0, 0, 0, 0, 0, 0, 0, active, churn, refund, fail, conv]) FROM g
),
report AS (SELECT *, unexpected = 0 AS success FROM lines)"""

_SUMMARY = """
  SELECT suite, count(*) FILTER (success) AS passed, count(*) AS total, max(rows) AS rows,
    coalesce(string_agg(expectation || ':' || "column", ','
      ORDER BY expectation || ':' || "column") FILTER (NOT success), '') AS failing,
    CASE WHEN bool_and(success) THEN 'PASS' ELSE 'FAIL' END AS status
  FROM {0} GROUP BY suite"""

_LABELS = [
    "payment_failure", "churn_spike", "seasonal_dip", "acquisition_drop", "pricing_effect",
    "infrastructure_issue",
]

_METRIC_TEXT = {
    "mrr": "'$' || CASE WHEN mrr >= 1000 THEN printf('%.1f', mrr / 1000.0) || 'k' "
    "ELSE printf('%.0f', mrr) END",
    "checkout_volume": "CASE WHEN checkout_volume >= 1000 THEN "
    "printf('%.1f', checkout_volume / 1000.0) || 'k' "
    "ELSE printf('%.0f', checkout_volume) END",
    "conversion_rate": "printf('%.1f', conversion_rate * 100.0) || '%'",
    "refund_rate": "printf('%.1f', refund_rate * 100.0) || '%'",
}

_RAW_LABEL = """CASE
  WHEN status = 'open' THEN ' Payment_Failure '
  WHEN event_type LIKE 'checkout%' THEN 'Seasonal  ' || raw
  WHEN event_type LIKE 'customer%' THEN 'Spike of churn ' || raw
  ELSE 'effect ' || raw END"""

ORACLE = {
    "json_fields": f"""WITH {sql.FEED}
      SELECT event_id, json_extract_string(payload, '$.id') AS id,
        json_extract_string(payload, '$.customer') AS customer,
        json_extract_string(payload, '$.subscription') AS subscription,
        json_extract_string(payload, '$.status') AS status,
        json_extract_string(payload, '$.currency') AS currency,
        json_extract_string(payload, '$.amount') AS amount
      FROM bronze""",
    "epoch_to_ts": f"""WITH {sql.FEED}
      SELECT event_id, strftime(to_timestamp(created_epoch) AT TIME ZONE 'UTC',
        '%Y-%m-%d %H:%M:%S') AS event_ts, strftime(event_date, '%Y-%m-%d') AS event_date
      FROM bronze""",
    "amount_parse": f"""WITH {sql.FEED}
      SELECT event_id,
        CASE WHEN event_type IN ('charge.refunded', 'invoice.payment_failed') THEN NULL
          ELSE CAST(json_extract_string(payload, '$.amount') AS BIGINT) END AS strict_cents,
        CASE WHEN event_type IN ('charge.refunded', 'invoice.payment_failed') THEN 0
          ELSE CAST(json_extract_string(payload, '$.amount') AS BIGINT) END AS live_cents
      FROM bronze""",
    "metric_contributions": f"""WITH {sql.CONTRIB}
      SELECT * REPLACE (strftime(event_date, '%Y-%m-%d') AS event_date) FROM contrib""",
    "cents_to_dollars": f"""WITH {sql.SILVER}
      SELECT event_id, round(CAST(amount_cents AS DOUBLE) / 100.0, 2) AS amount FROM silver""",
    "safe_ratio": f"""WITH {sql.GOLD}
      SELECT tenant_id, {_MD}, refund_rate AS gold_rate, coalesce(refund_rate, 0.0) AS live_rate
      FROM gold""",
    "dedupe_first": f"""WITH {sql.FEED}
      SELECT event_id, any_value(tenant_id) AS tenant_id, any_value(event_type) AS event_type,
        strftime(min(ingested_at), '%Y-%m-%d %H:%M:%S') AS ingested_at
      FROM bronze GROUP BY event_id""",
    "silver_events": f"""WITH {sql.SILVER}
      SELECT * REPLACE (strftime(event_date, '%Y-%m-%d') AS event_date,
        strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts) FROM silver""",
    "daily_kpi": f"WITH {sql.DAILY} SELECT * REPLACE ({_MD}) FROM daily",
    "live_daily_kpi": f"WITH {sql.LIVE} SELECT * REPLACE ({_MD}) FROM live",
    "running_mrr": f"WITH {sql.GOLD} SELECT tenant_id, {_MD}, mrr_cents_cum FROM running",
    "active_subs": f"WITH {sql.GOLD} SELECT tenant_id, {_MD}, active_subscriptions FROM gold",
    "churn_rate": f"WITH {sql.GOLD} SELECT tenant_id, {_MD}, churn_rate FROM gold",
    "gold_kpis": f"WITH {sql.GOLD} SELECT * REPLACE ({_MD}) FROM gold",
    "incremental_gold": f"WITH {sql.GOLD} SELECT * REPLACE ({_MD}) FROM gold",
    "golden_diff": f"""WITH {sql.GOLD}
      SELECT tenant_id, {_MD}, mrr AS expected_mrr, mrr AS actual_mrr,
        coalesce(conversion_rate, 0.0) AS expected_conversion_rate,
        conversion_rate AS actual_conversion_rate,
        coalesce(refund_rate, 0.0) AS expected_refund_rate, refund_rate AS actual_refund_rate
      FROM gold WHERE conversion_rate IS NULL OR refund_rate IS NULL""",
    "grain_unique": f"""WITH {sql.GOLD}
      SELECT 'gold' AS grain, tenant_id AS key, count(*) AS n FROM gold
      GROUP BY tenant_id, metric_date HAVING count(*) > 1
      UNION ALL SELECT 'bronze', event_id, count(*) FROM bronze
      GROUP BY event_id HAVING count(*) > 1""",
    "expect_row_count": f"""WITH {_REPORTS} SELECT * FROM report
      WHERE suite = 'gold' AND expectation = 'row_count_at_least_1'""",
    "expect_columns": f"""WITH {_REPORTS}
      SELECT suite, expectation, "column", rows,
        CAST(suite = 'bronze' AND "column" = 'payload' AS BIGINT) AS unexpected,
        NOT (suite = 'bronze' AND "column" = 'payload') AS success
      FROM report WHERE expectation = 'column_exists'""",
    "expect_not_null": f"""WITH {_REPORTS} SELECT * FROM report
      WHERE suite = 'bronze' AND expectation = 'not_null'""",
    "expect_between": f"""WITH {_REPORTS} SELECT * FROM report
      WHERE suite = 'gold' AND expectation = 'between'""",
    "expect_unique": f"""WITH {sql.SILVER},
      s AS (SELECT 'silver' AS suite, event_id FROM silver
            UNION ALL SELECT 'bronze', event_id FROM bronze),
      c AS (SELECT suite, event_id, count(*) AS n FROM s GROUP BY 1, 2)
      SELECT suite, count(*) FILTER (n > 1) AS unexpected, count(*) FILTER (n > 1) = 0 AS success
      FROM c GROUP BY suite""",
    "suite_report": f"WITH {_REPORTS} {_SUMMARY.format('report')}",
    "gated_run": f"""WITH {_REPORTS},
      sound AS (
        SELECT suite, expectation, "column", rows,
          CASE WHEN suite = 'bronze' THEN true ELSE success END AS success FROM report
        UNION ALL
        SELECT 'silver', unnest(['row_count_at_least_1', 'not_null', 'not_null', 'not_null']),
          unnest(['*', 'event_id', 'tenant_id', 'event_type']),
          (SELECT count(*) FROM silver), true
      ) {_SUMMARY.format('sound')}""",
    "label_normalise": f"""WITH {sql.SILVER},
      raws AS (
        SELECT *, array_to_string(list_transform(
            string_split(replace(event_type, '.', ' '), ' '),
            lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || status AS raw
        FROM silver
      ),
      cleaned AS (
        SELECT event_id, replace(lower(trim({_RAW_LABEL})), ' ', '_') AS c FROM raws
      ),
      words AS (
        SELECT event_id, c,
          list_distinct(list_filter(string_split(c, '_'), lambda w: w <> '')) AS ws FROM cleaned
      ),
      options AS (
        SELECT event_id, c, ws, unnest({_LABELS}) AS label,
          unnest([1, 2, 3, 4, 5, 6]) AS place FROM words
      ),
      best AS (
        SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY
          len(list_intersect(ws, string_split(label, '_'))) DESC, place) AS rn FROM options
      )
      SELECT event_id, CASE WHEN list_contains({_LABELS}, c) THEN c ELSE label END AS label
      FROM best WHERE rn = 1""",
    "severity_band": f"""WITH {sql.RECORDS}
      SELECT tenant_id, metric_date,
        CASE WHEN anomaly_score >= 0.97 THEN 'high' WHEN anomaly_score >= 0.9 THEN 'mid'
          ELSE 'low' END AS severity,
        CASE WHEN anomaly_score >= 0.9 THEN 'ok' WHEN anomaly_score >= 0.75 THEN 'warn'
          ELSE 'danger' END AS faithfulness
      FROM typed_records""",
    "metric_format": f"""WITH {sql.RECORDS}
      SELECT tenant_id, metric_date,
        upper(anomaly_type[1]) || replace(anomaly_type[2:], '_', ' ') AS type_label,
        CASE anomaly_type WHEN 'payment_failure' THEN '💳' WHEN 'churn_spike' THEN '📉'
          WHEN 'seasonal_dip' THEN '🗓️' WHEN 'acquisition_drop' THEN '🧲'
          WHEN 'pricing_effect' THEN '🏷️' ELSE '🚨' END AS type_icon,
        {", ".join(f"{v} AS {k}" for k, v in _METRIC_TEXT.items())}
      FROM typed_records""",
    "tokenize": f"""SELECT doc_id, array_to_string({sql.TOKENS.format("text")}, ' ') AS tokens
      FROM documents""",
    "extract_numbers": f"""WITH found AS (
        SELECT 'document' AS kind, doc_id AS id, {sql.NUMBERS.format("text")} AS xs FROM documents
        UNION ALL SELECT 'page', page_id, {sql.NUMBERS.format("html")} FROM pages
      )
      SELECT kind, id, len(xs) AS n, list_min(xs) AS least, list_max(xs) AS largest FROM found""",
}
