"""DuckDB SQL building blocks. Each constant is one or more CTEs that build on those before."""

from __future__ import annotations

FEED = """
typed AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
feed AS (
  SELECT
    'evt_' || event_id AS event_id,
    'acct_' || (user_id // 5) AS tenant_id,
    CASE
      WHEN event_type = 'signup' AND k % 4 = 0 THEN 'customer.subscription.deleted'
      WHEN event_type = 'signup' THEN 'customer.subscription.created'
      WHEN event_type = 'purchase' THEN 'invoice.paid'
      WHEN event_type = 'error' AND k % 2 = 0 THEN 'charge.refunded'
      WHEN event_type = 'error' THEN 'invoice.payment_failed'
      WHEN event_type = 'click' THEN 'checkout.session.completed'
      ELSE 'checkout.session.expired'
    END AS event_type,
    CAST(epoch_us(ts) // 1000000 AS BIGINT) AS created_epoch,
    CAST(to_json({
      'id': 'obj_' || event_id,
      'customer': CASE WHEN event_type <> 'view' THEN 'cus_' || user_id END,
      'amount': CAST(round(value * 100) AS BIGINT),
      'currency': 'usd',
      'subscription': CASE WHEN event_type IN ('signup', 'purchase', 'error')
                           THEN 'sub_' || user_id END,
      'status': CASE WHEN event_type = 'error' THEN 'open' ELSE 'complete' END
    }) AS VARCHAR) AS payload,
    ts,
    event_type AS raw_type
  FROM typed
),
bronze AS (
  SELECT event_id, tenant_id, event_type, created_epoch, payload, ts AS ingested_at,
         CAST(to_timestamp(created_epoch) AT TIME ZONE 'UTC' AS DATE) AS event_date
  FROM feed
  UNION ALL
  SELECT event_id, tenant_id, event_type, created_epoch, payload, ts + INTERVAL 1 HOUR,
         CAST(to_timestamp(created_epoch) AT TIME ZONE 'UTC' AS DATE)
  FROM feed WHERE raw_type = 'error'
)"""

SILVER = FEED + """,
silver AS (
  SELECT
    event_id, tenant_id, event_type,
    to_timestamp(created_epoch) AT TIME ZONE 'UTC' AS event_ts,
    event_date,
    json_extract_string(payload, '$.id') AS object_id,
    json_extract_string(payload, '$.customer') AS customer_id,
    json_extract_string(payload, '$.subscription') AS subscription_id,
    json_extract_string(payload, '$.status') AS status,
    json_extract_string(payload, '$.currency') AS currency,
    TRY_CAST(json_extract_string(payload, '$.amount') AS BIGINT) AS amount_cents
  FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingested_at) AS rn FROM bronze
  ) WHERE rn = 1
)"""

CONTRIB = SILVER + """,
contrib AS (
  SELECT tenant_id, event_date, event_id, event_type,
    CASE event_type WHEN 'customer.subscription.created' THEN amount_cents
                    WHEN 'customer.subscription.deleted' THEN -amount_cents ELSE 0 END
      AS mrr_delta_cents,
    CAST(event_type = 'customer.subscription.created' AS BIGINT) AS is_new_sub,
    CAST(event_type = 'customer.subscription.deleted' AS BIGINT) AS is_churned_sub,
    CASE WHEN event_type = 'invoice.paid' THEN amount_cents ELSE 0 END AS gross_revenue_cents,
    CAST(event_type = 'invoice.paid' AS BIGINT) AS is_successful_payment,
    CAST(event_type = 'invoice.payment_failed' AS BIGINT) AS is_failed_payment,
    CASE WHEN event_type = 'charge.refunded' THEN amount_cents ELSE 0 END AS refund_cents,
    CAST(event_type = 'checkout.session.completed' AS BIGINT) AS is_checkout_completed,
    CAST(event_type = 'checkout.session.expired' AS BIGINT) AS is_checkout_expired
  FROM silver
)"""

DAILY = CONTRIB + """,
daily AS (
  SELECT tenant_id, event_date AS metric_date,
    CAST(sum(mrr_delta_cents) AS BIGINT) AS mrr_delta_cents,
    CAST(sum(is_new_sub) AS BIGINT) AS new_subscriptions,
    CAST(sum(is_churned_sub) AS BIGINT) AS churned_subscriptions,
    CAST(sum(gross_revenue_cents) AS BIGINT) AS gross_revenue_cents,
    CAST(sum(refund_cents) AS BIGINT) AS refund_cents,
    CAST(sum(is_successful_payment) AS BIGINT) AS successful_payments,
    CAST(sum(is_failed_payment) AS BIGINT) AS failed_payments,
    CAST(sum(is_checkout_completed) AS BIGINT) AS checkouts_completed,
    CAST(sum(is_checkout_expired) AS BIGINT) AS checkouts_expired
  FROM contrib GROUP BY tenant_id, event_date
)"""

GOLD = DAILY + """,
running AS (
  SELECT *,
    CAST(sum(mrr_delta_cents) OVER w AS BIGINT) AS mrr_cents_cum,
    CAST(sum(new_subscriptions - churned_subscriptions) OVER w AS BIGINT) AS active_subscriptions
  FROM daily
  WINDOW w AS (PARTITION BY tenant_id ORDER BY metric_date
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
gold AS (
  SELECT tenant_id, metric_date,
    round(CAST(mrr_cents_cum AS DOUBLE) / 100.0, 2) AS mrr,
    active_subscriptions, new_subscriptions, churned_subscriptions,
    round(churned_subscriptions / CAST(nullif(
      active_subscriptions - new_subscriptions + churned_subscriptions, 0) AS DOUBLE), 4)
      AS churn_rate,
    round(CAST(gross_revenue_cents AS DOUBLE) / 100.0, 2) AS gross_revenue,
    round(CAST(refund_cents AS DOUBLE) / 100.0, 2) AS refund_amount,
    round(refund_cents / CAST(nullif(gross_revenue_cents, 0) AS DOUBLE), 4) AS refund_rate,
    successful_payments, failed_payments,
    round(failed_payments / CAST(nullif(failed_payments + successful_payments, 0) AS DOUBLE), 4)
      AS payment_failure_rate,
    checkouts_completed, checkouts_expired,
    round(checkouts_completed / CAST(nullif(checkouts_completed + checkouts_expired, 0)
      AS DOUBLE), 4) AS conversion_rate
  FROM running
)"""

LIVE = DAILY + """,
live AS (
  SELECT tenant_id, metric_date,
    round(CAST(sum(mrr_delta_cents) OVER (PARTITION BY tenant_id ORDER BY metric_date) AS DOUBLE)
      / 100.0, 2) AS mrr,
    coalesce(round(checkouts_completed / CAST(nullif(checkouts_completed + checkouts_expired, 0)
      AS DOUBLE), 4), 0.0) AS conversion_rate,
    coalesce(round(refund_cents / CAST(nullif(gross_revenue_cents, 0) AS DOUBLE), 4), 0.0)
      AS refund_rate,
    CAST(checkouts_completed + checkouts_expired AS DOUBLE) AS checkout_volume
  FROM daily
)"""

FEATURES = GOLD + """,
features AS (
  SELECT tenant_id, metric_date, mrr,
    coalesce(conversion_rate, 0.0) AS conversion_rate,
    coalesce(refund_rate, 0.0) AS refund_rate,
    CAST(checkouts_completed + checkouts_expired AS DOUBLE) AS checkout_volume,
    CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY metric_date) - 1 AS INTEGER) AS day
  FROM gold
)"""

METRICS = ["mrr", "conversion_rate", "refund_rate", "checkout_volume"]


def rolling_z(metric: str, window: str) -> str:
    std = f"stddev_samp({metric}) OVER {window}"
    return (
        f"abs(({metric} - avg({metric}) OVER {window}) / "
        f"CASE WHEN {std} IS NULL OR {std} = 0 THEN 1.0 ELSE {std} END)"
    )


ZSCORES = FEATURES + f""",
zscores AS (
  SELECT *, round(greatest({", ".join(rolling_z(m, "w") for m in METRICS)}), 9) AS zscore
  FROM features
  WINDOW w AS (PARTITION BY tenant_id ORDER BY metric_date
               ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
)"""

SCORED = ZSCORES + """,
scored AS (
  SELECT *,
    CASE WHEN count(*) OVER () <= 1 THEN 0.0 ELSE
      CAST(row_number() OVER (ORDER BY zscore, tenant_id, metric_date) - 1 AS DOUBLE)
      / (count(*) OVER () - 1) END AS score
  FROM zscores
)"""


def _deviation(metric: str, place: int) -> str:
    sd = (
        f"({metric} - {metric}_mean) / CASE WHEN {metric}_std IS NULL OR {metric}_std = 0 "
        f"THEN 1.0 ELSE {metric}_std END"
    )
    return (
        f"{{'size': -round(abs({sd}), 9), 'place': {place}, 'metric': '{metric}', 'sd': {sd}}}"
    )


def _value(metric_expr: str, suffix: str = "") -> str:
    cases = " ".join(f"WHEN '{m}' THEN {m}{suffix}" for m in METRICS)
    return f"CASE {metric_expr} {cases} END"


def _sentence(metric_expr: str) -> str:
    value, mean = _value(metric_expr), _value(metric_expr, "_mean")
    moved = (
        f"printf('%.0f', CASE WHEN {mean} = 0 THEN 0.0 "
        f"ELSE abs(({value} - {mean}) / {mean}) * 100.0 END)"
    )
    level = f"printf('%.1f', {value} * 100.0) || '%'"
    up = f"{value} > {mean}"
    return f"""CASE
      WHEN {metric_expr} = 'mrr' AND {up} THEN 'MRR rose ' || {moved} || '% above its usual level.'
      WHEN {metric_expr} = 'mrr' THEN 'MRR fell ' || {moved} || '% below its usual level.'
      WHEN {metric_expr} = 'refund_rate' AND {up}
        THEN 'Refund rate climbed to ' || {level} || ', well above normal.'
      WHEN {metric_expr} = 'refund_rate' THEN 'Refund rate dropped to ' || {level} || '.'
      WHEN {metric_expr} = 'conversion_rate' AND {up}
        THEN 'Conversion rate rose to ' || {level} || '.'
      WHEN {metric_expr} = 'conversion_rate' THEN 'Conversion rate slipped to ' || {level} || '.'
      WHEN {up} THEN 'Checkout volume jumped ' || {moved} || '% above baseline.'
      ELSE 'Checkout volume dropped ' || {moved} || '% below baseline.' END"""


_STATS = ", ".join(
    f"avg({m}) OVER t AS {m}_mean, stddev_samp({m}) OVER t AS {m}_std" for m in METRICS
)
_DEVS = ", ".join(_deviation(m, i) for i, m in enumerate(METRICS))
_RULE = """CASE
      WHEN {m} = 'refund_rate' THEN 'payment_failure'
      WHEN {m} = 'mrr' AND {s} > 0 THEN 'pricing_effect'
      WHEN {m} = 'mrr' THEN 'churn_spike'
      WHEN {m} = 'checkout_volume' AND {s} > 0 THEN 'seasonal_dip'
      WHEN {m} = 'checkout_volume' THEN 'acquisition_drop'
      ELSE 'infrastructure_issue' END"""

RECORDS = SCORED + f""",
statted AS (
  SELECT *, {_STATS} FROM scored WINDOW t AS (PARTITION BY tenant_id)
),
ordered AS (
  SELECT *, list_sort([{_DEVS}]) AS devs FROM statted
),
records AS (
  SELECT tenant_id, strftime(metric_date, '%Y-%m-%d') AS metric_date, metric_date AS day_value,
    score AS anomaly_score,
    devs[1].metric AS m1, devs[2].metric AS m2, devs[3].metric AS m3,
    round(devs[1].sd, 2) AS s1, round(devs[2].sd, 2) AS s2, round(devs[3].sd, 2) AS s3,
    {_sentence("devs[1].metric")} || ' ' || {_sentence("devs[2].metric")} AS description,
    {", ".join(f"round({m}, 4) AS {m}" for m in METRICS)}
  FROM ordered
),
typed_records AS (
  SELECT *,
    {_RULE.format(m="m1", s="s1")} AS anomaly_type,
    coalesce(round(abs(s1) / nullif(abs(s1) + abs(s2) + abs(s3), 0), 4), 0.0) AS type_confidence,
    m1 || ' (' || printf('%+.2f', s1) || 'sd), ' || m2 || ' (' || printf('%+.2f', s2)
      || 'sd), ' || m3 || ' (' || printf('%+.2f', s3) || 'sd)' AS drivers
  FROM records
),
flagged AS (SELECT * FROM typed_records WHERE anomaly_score >= 0.95)"""

TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
NUMBERS = (
    "list_transform(regexp_extract_all(replace({0}, '−', '-'), '-?\\d[\\d,]*(?:\\.\\d+)?'), "
    "lambda x: CAST(replace(x, ',', '') AS DOUBLE))"
)

BM25 = f"""
dtok AS (SELECT doc_id, {TOKENS.format("text")} AS toks FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dtok),
df AS (
  SELECT token, count(*) AS df
  FROM (SELECT unnest(list_distinct(toks)) AS token FROM dtok) GROUP BY token
),
raw_idf AS (
  SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, corpus
),
idf AS (
  SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf
  FROM raw_idf
),
asked AS (
  SELECT query_id, token, count(*) AS times
  FROM (SELECT query_id, unnest({TOKENS.format("text")}) AS token FROM asking)
  GROUP BY ALL
),
postings AS (
  SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS token FROM dtok)
  WHERE token IN (SELECT token FROM asked) GROUP BY doc_id, token
),
bm25 AS (
  SELECT query_id, doc_id,
    round(sum(times * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM postings JOIN asked USING (token) JOIN idf USING (token), corpus
  GROUP BY query_id, doc_id
)"""

HYBRID = BM25 + f""",
dvec AS (
  SELECT doc_id, CAST('0x' || substr(md5(token), 1, 2) AS INTEGER) AS bucket, count(*) AS n
  FROM (SELECT doc_id, unnest(toks) AS token FROM dtok) GROUP BY 1, 2
),
qvec AS (
  SELECT query_id, CAST('0x' || substr(md5(token), 1, 2) AS INTEGER) AS bucket, sum(times) AS n
  FROM asked GROUP BY 1, 2
),
dnorm AS (SELECT doc_id, sqrt(sum(CAST(n AS DOUBLE) * n)) AS norm FROM dvec GROUP BY 1),
qnorm AS (SELECT query_id, sqrt(sum(CAST(n AS DOUBLE) * n)) AS norm FROM qvec GROUP BY 1),
cosine AS (
  SELECT query_id, doc_id, round(dot / (d.norm * q.norm), 9) AS score
  FROM (SELECT query_id, doc_id, sum(CAST(qvec.n AS DOUBLE) * dvec.n) AS dot
        FROM qvec JOIN dvec USING (bucket) GROUP BY 1, 2)
  JOIN dnorm d USING (doc_id) JOIN qnorm q USING (query_id)
),
pairs AS (
  SELECT a.query_id, d.doc_id, d.doc_id % 60 AS recency_minutes,
    coalesce(c.score, 0.0) AS dense, coalesce(b.score, 0.0) AS sparse
  FROM asking a CROSS JOIN documents d
  LEFT JOIN cosine c ON c.query_id = a.query_id AND c.doc_id = d.doc_id
  LEFT JOIN bm25 b ON b.query_id = a.query_id AND b.doc_id = d.doc_id
),
ranks AS (
  SELECT *,
    row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id DESC) - 1 AS dr,
    row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, doc_id DESC) - 1 AS sr
  FROM pairs
),
fused AS (
  SELECT query_id, doc_id,
    (1.0::DOUBLE / (60 + dr) + 1.0::DOUBLE / (60 + sr))
      * CASE WHEN recency_minutes <= 15 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS score
  FROM ranks
),
found AS (
  SELECT query_id, doc_id, CAST(printf('%.5f', score) AS DOUBLE) AS retrieval_score, position
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) - 1
          AS position FROM fused)
)"""
