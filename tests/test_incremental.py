"""Gold by batches, and tables published by version."""

from __future__ import annotations

import datetime
import glob
import random

import pytest

from tidemark.plans import incremental, medallion
from tidemark.sources import published, sinks, tables

SCHEMA = (
    "event_id string, tenant_id string, event_type string, created_epoch long, payload string, "
    "livemode boolean, ingested_at timestamp"
)
FIRST = datetime.datetime(2026, 1, 20, tzinfo=datetime.timezone.utc)
KINDS = [
    "customer.subscription.created", "customer.subscription.deleted", "invoice.paid",
    "invoice.payment_failed", "charge.refunded", "checkout.session.completed", "checkout.session.expired",
]


def events(n=500, seed=1):
    """Three months of events; a few have no date, no tenant or no amount."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        at = int((FIRST + datetime.timedelta(days=rng.randrange(70), seconds=rng.randrange(86400))).timestamp())
        amount = rng.choice(["null", str(rng.randrange(9000)), '"x"'] if k % 9 == 0 else [str(rng.randrange(9000))])
        rows.append((
            f"e{k}", rng.choice(["a", "b", "c", None] if k % 7 == 0 else ["a", "b", "c"]), rng.choice(KINDS),
            None if k % 50 == 0 else at, f'{{"amount": {amount}}}', False, FIRST + datetime.timedelta(hours=k),
        ))
    return rows


def bronze(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def listed(df):
    return sorted(map(repr, df.collect()))


def test_batches_equal_the_full_build(spark, tmp_path):
    rows, root = events(), str(tmp_path / "gold")
    late = [r for k, r in enumerate(rows) if k % 4 == 3]
    batches = [[r for k, r in enumerate(rows) if k % 4 != 3], late, rows[::3], []]
    for number, batch in enumerate(batches):
        for _ in range(1 + number % 2):  # every other batch is applied again
            incremental.apply_batch(spark, bronze(spark, batch), root, number)
    whole = medallion.gold_from_bronze(bronze(spark, rows))
    assert listed(incremental.read_gold(spark, root)) == listed(whole)
    for first in (datetime.date(2026, 2, 1), datetime.date(2026, 2, 17), datetime.date(2026, 3, 30)):
        last = first + datetime.timedelta(days=12)
        part = whole.where(f"metric_date between date '{first}' and date '{last}'")
        assert listed(incremental.read_gold(spark, root, first, last)) == listed(part)


def test_only_touched_days_are_read(spark, tmp_path):
    rows, root = events(), str(tmp_path / "gold")
    incremental.apply_batch(spark, bronze(spark, rows), root, 0)
    day = datetime.date(2026, 2, 17)
    for path in glob.glob(f"{root}/*/batch_id=0/*/*.parquet"):
        if f"={day}" not in path and "log_day=2026-02-01" not in path:
            with open(path, "wb") as file:  # cannot be read any more
                file.write(b"gone")
    at = int(datetime.datetime(2026, 2, 17, 12, tzinfo=datetime.timezone.utc).timestamp())
    new = ("late", "a", "customer.subscription.created", at, '{"amount": 700}', False, FIRST)
    old = next(r for r in rows if r[3] and datetime.datetime.fromtimestamp(r[3], datetime.timezone.utc).date() == day)
    incremental.apply_batch(spark, bronze(spark, [new, old]), root, 1)
    written = spark.read.parquet(f"{root}/events/batch_id=1")
    assert [r["event_id"] for r in written.collect()] == ["late"]


def test_a_killed_publish_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "table")
    write = lambda n: lambda folder: spark.range(n).write.parquet(folder)
    assert published.current(spark, path) == path
    assert published.publish(spark, path, write(3)) == 0

    def dies(folder):
        spark.range(9).write.parquet(folder)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        published.publish(spark, path, dies)
    assert spark.read.parquet(published.current(spark, path)).count() == 3
    assert published.publish(spark, path, write(5)) == 2  # the folder of the dead one is not used again
    assert spark.read.parquet(published.current(spark, path)).count() == 5
    published.publish(spark, path, write(6))
    published.retire(spark, path, keep=1)
    assert published.versions(spark, path) == [3]
    assert [p.rsplit("=")[-1] for p in glob.glob(f"{path}/version=*")] == ["3"]


def test_gated_gold_is_read_in_its_current_version(spark, tmp_path):
    path = str(tmp_path / "gold")
    rows = [r for r in events(200) if r[1] and r[3]]
    medallion.gated_run(bronze(spark, rows), path, enforce=False)
    before = tables.read_gold(spark, path)
    counted = before.count()
    medallion.gated_run(bronze(spark, rows[:50]), path, enforce=False)
    assert before.count() == counted  # an open reader keeps its version
    assert tables.read_gold(spark, path).count() < counted
    sinks.write_gold(before, str(tmp_path / "plain"))
    assert tables.read_gold(spark, str(tmp_path / "plain")).count() == counted
