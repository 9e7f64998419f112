from __future__ import annotations

import csv

import pytest
from feed import GOLD, LIVE, events, messages
from pyspark.sql import functions as F

from tidemark.operators import features, ingest, kpis, quality, silver
from tidemark.plans import medallion
from tidemark.schemas import BRONZE
from tidemark.sources import bus, sinks, tables


@pytest.fixture(scope="module")
def bronze(spark):
    raw = spark.createDataFrame([(m,) for m in messages()], "value binary")
    return ingest.to_bronze(raw)


def rows(df):
    return sorted(
        tuple(str(v) if hasattr(v, "isoformat") else v for v in r) for r in df.collect()
    )


def test_bronze_columns_and_values(spark, bronze):
    assert bronze.columns == [f.name for f in BRONZE.fields]
    first = bronze.where("event_id = 'evt_0001'").first()
    assert str(first["event_date"]) == "2026-03-09"
    assert first["payload"].startswith('{"id":"obj_1"')


def test_bronze_keeps_rows_it_cannot_read(spark):
    raw = spark.createDataFrame(
        [(b'{"id":"e1","tenant_id":"t","created":1780308180,"data":{}}',), (b"\xff not json",)],
        "value binary",
    )
    dated = spark.createDataFrame([('{"id":"e2","created":"2026-05-01T10:00:00Z"}',)], "value string")
    assert str(ingest.to_bronze(dated).first()["event_date"]) == "2026-05-01"
    got = ingest.to_bronze(raw).orderBy(F.col("event_id").asc_nulls_last()).collect()
    assert [r["event_id"] for r in got] == ["e1", None]
    assert got[0]["payload"] is None and got[1]["event_date"] is None


def test_gold_is_exact(bronze):
    gold = medallion.gold_from_bronze(bronze)
    assert rows(gold) == sorted(GOLD)


def test_live_is_exact_and_agrees_with_gold(bronze):
    typed = silver.to_silver(bronze).withColumn("amount", F.col("amount_cents").cast("string"))
    live = kpis.live_kpis(kpis.live_daily(typed))
    assert rows(live) == sorted(LIVE)
    assert kpis.mismatches(
        live, medallion.gold_from_bronze(bronze), ["tenant_id", "metric_date"], ["mrr"]
    ).isEmpty()


def test_live_opens_a_day_for_any_event_and_reads_bad_amounts_as_zero(spark):
    events_ = spark.createDataFrame(
        [("t", "2026-06-01", "ping", None), ("t", "2026-06-02", "invoice.paid", "12x")],
        "tenant_id string, event_date string, event_type string, amount string",
    ).withColumn("event_date", F.to_date("event_date"))
    assert rows(kpis.live_kpis(kpis.live_daily(events_))) == [
        ("t", "2026-06-01", 0.0, 0.0, 0.0, 0.0),
        ("t", "2026-06-02", 0.0, 0.0, 0.0, 0.0),
    ]


def test_dedupe_keeps_the_first_delivery_of_a_hot_key(spark):
    copies = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("event_id"),
        F.col("id").alias("at"),
    )
    got = silver.first_delivery(copies, "event_id", [F.col("at").asc()])
    assert got.where("event_id = 'hot'").first()["at"] == 0
    assert got.count() == copies.select("event_id").distinct().count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before, once after the shuffle


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "bronze.csv"
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(
            "event_id source tenant_id event_type livemode created_epoch api_version payload "
            "ingested_at".split()
        )
        for e, m in zip(events(), messages(), strict=True):
            payload = m.decode().split('"object":', 1)[1][:-2]
            out.writerow([e["id"], e["source"], e["tenant_id"], e["event_type"], "false",
                          e["created"], e["api_version"], payload, "2026-06-03T12:00:00"])
    assert rows(medallion.gold_from_bronze(tables.read_bronze_csv(spark, str(path)))) == sorted(GOLD)


def test_webhooks_are_accepted_routed_or_quarantined(spark):
    raw = spark.createDataFrame(
        [
            ('{"id":"e1","type":"invoice.paid","account":"acct_A","created":1,'
             '"data":{"object":{"id":"in_1"}}}',),
            ('{"id":"e2","type":"invoice.paid","data":{}}',),
            ("not-json",),
            ('{"type":"no id","data":{}}',),
            ('{"id":"e3","type":"invoice.paid","data":{}} and more',),
            ('{"id":"e4","type":"invoice.paid","data":{}},{"id":"e5","type":"x","data":{}}',),
        ],
        "value string",
    )
    parsed = ingest.parse_webhooks(raw)
    counts = {r["outcome"]: r["events"] for r in ingest.outcome_counts(parsed).collect()}
    assert counts == {"accepted": 2, "rejected_payload": 4}
    assert ingest.quarantine(parsed).count() == 4
    records = {r["topic"]: r for r in bus.bus_records(ingest.envelopes(parsed)).collect()}
    assert records["stripe.events.acct_A"]["key"] == "acct_A"
    assert records["stripe.events.acct_A"]["value"].endswith(',"data":{"object":{"id":"in_1"}}}')
    assert records["stripe.events.unknown"]["key"] is None
    assert '"livemode":false' in records["stripe.events.unknown"]["value"]


GOLD_FRAME = (
    "tenant_id string, metric_date date, mrr double, active_subscriptions int, churn_rate double, "
    "refund_rate double, payment_failure_rate double, conversion_rate double"
)


@pytest.mark.parametrize(
    ("row", "status", "failing"),
    [
        (("t", 100.0, 2, None, 0.1, 0.0, None), "PASS", ""),
        (("t", None, 2, 0.0, 0.1, 0.0, 0.5), "FAIL", "not_null:mrr"),
        (("t", 100.0, 2, 0.0, 0.1, 0.0, 1.5), "FAIL", "between:conversion_rate"),
        (("t", 100.0, -1, 0.0, 0.1, 0.0, 0.5), "FAIL", "between:active_subscriptions"),
    ],
)
def test_gold_gates(spark, row, status, failing):
    df = spark.createDataFrame([row], GOLD_FRAME.replace("metric_date date, ", "")).withColumn(
        "metric_date", F.lit("2026-06-01").cast("date")
    )
    summary = quality.suite_summary(quality.report(df, "gold", quality.gold_checks(df))).first()
    assert (summary["status"], summary["failing"]) == (status, failing)


def test_empty_table_and_missing_column_fail(spark):
    df = spark.createDataFrame([], "event_id string, tenant_id string, event_type string")
    report = quality.report(df, "bronze", quality.bronze_checks(df))
    failed = {(r["expectation"], r["column"]) for r in report.where("not success").collect()}
    assert failed == {("row_count_at_least_1", "*"), ("column_exists", "payload")}


def test_gated_run_raises_on_breach(spark, bronze, tmp_path):
    assert medallion.gated_run(bronze, str(tmp_path / "ok")).where("status = 'FAIL'").isEmpty()
    broken = bronze.withColumn("tenant_id", F.lit(None).cast("string"))
    with pytest.raises(quality.GateBreach, match="bronze"):
        medallion.gated_run(broken, str(tmp_path / "ok"))
    published = tables.read_gold(spark, str(tmp_path / "ok"))
    assert published.where("tenant_id IS NOT NULL").count() == len(GOLD)  # as before the breach


def test_upsert_log_is_idempotent_and_newest_wins(spark, tmp_path):
    path = str(tmp_path / "log")
    frame = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    sinks.upsert_batch(frame(("a", 1), ("b", 1)), path, 0)
    for _ in range(2):  # a retried batch
        sinks.upsert_batch(frame(("b", 2), ("c", 2)), path, 1)
    assert rows(sinks.read_upserted(spark, path, ["k"])) == [("a", 1), ("b", 2), ("c", 2)]


LOGGED = "k string, day string, v int, s string"


def test_log_upsert_updates_only_what_it_is_told(spark, tmp_path):
    path = str(tmp_path / "log")
    old = [("a", "2026-03-01", 1, "x"), ("b", "2026-03-01", 1, "x"), ("b", "2026-03-02", 1, "x")]
    new = [("b", "2026-03-01", 2, "y"), ("c", "2026-03-04", 2, "y")]
    for batch, made in enumerate((old, new, new)):
        changes = spark.createDataFrame(made, LOGGED)
        number = min(batch, 1)  # the last one is a retry
        sinks.upsert_columns(changes, path, number, ["k", "day"], ["s"], "day")
    expected = [
        ("a", "2026-03-01", 1, "x"), ("b", "2026-03-01", 1, "y"), ("b", "2026-03-02", 1, "x"),
        ("c", "2026-03-04", 2, "y"),
    ]
    assert rows(sinks.read_upserted(spark, path, ["k", "day"])) == expected


def test_compacted_log_holds_each_key_once_and_goes_on(spark, tmp_path):
    path, into = str(tmp_path / "log"), str(tmp_path / "compact")
    for batch in range(3):
        changes = [("a", "2026-03-01", batch, "x"), (f"b{batch}", "2026-03-02", batch, "x")]
        sinks.upsert_batch(spark.createDataFrame(changes, LOGGED), path, batch, "day")
    sinks.compact(spark, path, into, ["k", "day"])
    assert spark.read.parquet(into).count() == 4
    assert rows(sinks.read_upserted(spark, into, ["k", "day"])) == rows(
        sinks.read_upserted(spark, path, ["k", "day"])
    )
    later = spark.createDataFrame([("a", "2026-03-01", 9, "z")], LOGGED)
    sinks.upsert_columns(later, into, 3, ["k", "day"], ["s"], "day")
    assert ("a", "2026-03-01", 2, "z") in rows(sinks.read_upserted(spark, into, ["k", "day"]))


def test_adapter_sums_volume_and_fills_rates(spark):
    gold = spark.createDataFrame(
        [("a", "2026-06-02", 1.0, None, 0.1, 35, 15), ("a", "2026-06-01", 1.0, 0.5, 0.1, 40, 10),
         ("b", "2026-06-01", 1.0, 0.5, 0.1, 80, 20)],
        "tenant_id string, metric_date string, mrr double, conversion_rate double, "
        "refund_rate double, checkouts_completed long, checkouts_expired long",
    )
    got = rows(features.day_index(features.adapt(gold)))
    assert got == [
        ("a", "2026-06-01", 1.0, 0.5, 0.1, 50.0, 0),
        ("a", "2026-06-02", 1.0, 0.0, 0.1, 50.0, 1),
        ("b", "2026-06-01", 1.0, 0.5, 0.1, 100.0, 0),
    ]
    with pytest.raises(ValueError, match="mrr"):
        features.adapt(gold.drop("mrr"))
