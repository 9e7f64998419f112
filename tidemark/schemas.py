"""Schemas and fixed vocabularies shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# Metric names, anomaly labels, event types, thresholds.
METRICS = ["mrr", "conversion_rate", "refund_rate", "checkout_volume"]
RATE_METRICS = ["conversion_rate", "refund_rate"]
LABELS = [
    "payment_failure",
    "churn_spike",
    "seasonal_dip",
    "acquisition_drop",
    "pricing_effect",
    "infrastructure_issue",
]
TYPE_LABELS = {
    "payment_failure": ("Payment failure", "💳"),
    "churn_spike": ("Churn spike", "📉"),
    "seasonal_dip": ("Seasonal dip", "🗓️"),
    "acquisition_drop": ("Acquisition drop", "🧲"),
    "pricing_effect": ("Pricing effect", "🏷️"),
    "infrastructure_issue": ("Infrastructure issue", "🚨"),
}
ALERT_ICONS = {"payment_failure": "💳", "churn_spike": "📉", "infrastructure_issue": "🚨"}
DEFAULT_ICON = "⚠️"

SUB_CREATED = "customer.subscription.created"
SUB_DELETED = "customer.subscription.deleted"
INVOICE_PAID = "invoice.paid"
INVOICE_FAILED = "invoice.payment_failed"
CHARGE_REFUNDED = "charge.refunded"
CHECKOUT_DONE = "checkout.session.completed"
CHECKOUT_EXPIRED = "checkout.session.expired"

TOPIC_PREFIX = "stripe.events."
UNKNOWN_TOPIC = "stripe.events.unknown"
TOPIC_PATTERN = r"stripe\.events\..*"

LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]

SCORE_THRESHOLD = 0.95
FAITHFULNESS_THRESHOLD = 0.85
REVIEW_CONFIDENCE = 0.6

# The webhook body as the provider sends it; `data` stays text.
PROVIDER_EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("account", T.StringType()),
        T.StructField("livemode", T.BooleanType()),
        T.StructField("created", T.LongType()),
        T.StructField("api_version", T.StringType()),
    ]
)

# The envelope on the message bus; `data` is read separately as text.
ENVELOPE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("livemode", T.BooleanType()),
        T.StructField("created", T.LongType()),
        T.StructField("api_version", T.StringType()),
    ]
)

BRONZE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("livemode", T.BooleanType()),
        T.StructField("created_epoch", T.LongType()),
        T.StructField("api_version", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
    ]
)

# The CSV hand-off form has no partition column.
BRONZE_CSV = T.StructType([f for f in BRONZE.fields if f.name != "event_date"])

# The fields read out of the payload. All text: silver casts the amount itself.
PAYLOAD = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("id", "customer", "subscription", "status", "currency", "amount")
    ]
)

CONTRIBUTIONS = [
    "mrr_delta_cents",
    "is_new_sub",
    "is_churned_sub",
    "gross_revenue_cents",
    "is_successful_payment",
    "is_failed_payment",
    "refund_cents",
    "is_checkout_completed",
    "is_checkout_expired",
]
