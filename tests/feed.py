"""A small provider feed with KPIs worked out by hand: two tenants, gaps, two re-deliveries."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

_FIRST = datetime(2026, 3, 9, 7, 30, tzinfo=timezone.utc)
DAY = {n: int((_FIRST + timedelta(days=n - 1)).timestamp()) for n in range(1, 5)}

CREATED, DELETED = "customer.subscription.created", "customer.subscription.deleted"
PAID, FAILED, REFUND = "invoice.paid", "invoice.payment_failed", "charge.refunded"
DONE, EXPIRED = "checkout.session.completed", "checkout.session.expired"

_PLAN = [
    ("harbor_co", 1, [(CREATED, 3000), (CREATED, 4500), (CREATED, 2500), (PAID, 3000), (PAID, 4500),
                      (FAILED, 2500), (DONE, 3000), (DONE, 4500), (DONE, 2500), (EXPIRED, 900)]),
    ("quill_ltd", 1, [(CREATED, 9900), (PAID, 9900)]),
    ("harbor_co", 2, [(DELETED, 4500), (PAID, 2500), (REFUND, 1500), (EXPIRED, 100), (EXPIRED, 100)]),
    ("quill_ltd", 3, [(DELETED, 9900), (REFUND, 9900)]),
    ("harbor_co", 4, [(CREATED, 12000), (DELETED, 2500), (PAID, 12000), (PAID, 3000), (FAILED, 3000),
                      (FAILED, 3000), (REFUND, 3000), (DONE, 12000)]),
    ("quill_ltd", 4, [(CREATED, 4400), (DONE, 4400), (PAID, 4400)]),
]


def events() -> list[dict]:
    out = []
    for tenant, day, entries in _PLAN:
        for kind, amount in entries:
            n = len(out) + 1
            out.append(
                {
                    "id": f"evt_{n:04d}",
                    "source": "stripe",
                    "tenant_id": tenant,
                    "event_type": kind,
                    "livemode": False,
                    "created": DAY[day] + 60 * n,
                    "api_version": "2024-06-20",
                    "data": {
                        "object": {
                            "id": f"obj_{n}",
                            "customer": None if kind == EXPIRED else f"cus_{n}",
                            "amount": amount,
                            "currency": "usd",
                            "subscription": None,
                            "status": "ok",
                        }
                    },
                }
            )
    return [*out, dict(out[4]), dict(out[0])]  # two are delivered again


def messages() -> list[bytes]:
    return [json.dumps(e, separators=(",", ":")).encode() for e in events()]


# tenant, date, mrr, active, new, churned, churn_rate, gross, refund, refund_rate,
# ok, failed, failure_rate, completed, expired, conversion
GOLD = [
    ("harbor_co", "2026-03-09", 100.0, 3, 3, 0, None, 75.0, 0.0, 0.0, 2, 1, 0.3333, 3, 1, 0.75),
    ("harbor_co", "2026-03-10", 55.0, 2, 0, 1, 0.3333, 25.0, 15.0, 0.6, 1, 0, 0.0, 0, 2, 0.0),
    ("harbor_co", "2026-03-12", 150.0, 2, 1, 1, 0.5, 150.0, 30.0, 0.2, 2, 2, 0.5, 1, 0, 1.0),
    ("quill_ltd", "2026-03-09", 99.0, 1, 1, 0, None, 99.0, 0.0, 0.0, 1, 0, 0.0, 0, 0, None),
    ("quill_ltd", "2026-03-11", 0.0, 0, 0, 1, 1.0, 0.0, 99.0, None, 0, 0, None, 0, 0, None),
    ("quill_ltd", "2026-03-12", 44.0, 1, 1, 0, None, 44.0, 0.0, 0.0, 1, 0, 0.0, 1, 0, 1.0),
]

LIVE = [
    ("harbor_co", "2026-03-09", 100.0, 0.75, 0.0, 4.0),
    ("harbor_co", "2026-03-10", 55.0, 0.0, 0.6, 2.0),
    ("harbor_co", "2026-03-12", 150.0, 1.0, 0.2, 1.0),
    ("quill_ltd", "2026-03-09", 99.0, 0.0, 0.0, 0.0),
    ("quill_ltd", "2026-03-11", 0.0, 0.0, 0.0, 0.0),
    ("quill_ltd", "2026-03-12", 44.0, 1.0, 0.0, 1.0),
]
