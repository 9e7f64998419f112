from __future__ import annotations

import pytest
from feed import LIVE, messages
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.sources import bus
from tidemark.streaming import bronze_landing, live_kpis

ENVELOPES = "value binary"


@pytest.fixture
def folders(tmp_path):
    return lambda name: str(tmp_path / name)


def write(spark, path, batch):
    spark.createDataFrame([(m,) for m in batch], ENVELOPES).coalesce(1).write.mode(
        "append"
    ).parquet(path)


def stream(spark, path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("value", T.BinaryType())])
    return bus.read_files_as_stream(spark, path, schema, max_files_per_trigger=1)


def events(spark, path):
    return live_kpis.typed_events(ingest.to_bronze(stream(spark, path)))


def done(query):
    query.awaitTermination()
    assert query.exception() is None


def as_rows(df):
    return sorted(
        tuple(str(v) if hasattr(v, "isoformat") else v for v in r) for r in df.collect()
    )


def parts(n):
    all_messages = messages()
    return [all_messages[i::n] for i in range(n)]


def test_landing_is_partitioned_and_resumes_exactly_once(spark, folders):
    source, table, checkpoint = folders("in"), folders("bronze"), folders("cp")
    first, second = parts(2)
    write(spark, source, first)
    done(bronze_landing.land(stream(spark, source), table, checkpoint, available_now=True))
    write(spark, source, [*second, b"broken"])
    done(bronze_landing.land(stream(spark, source), table, checkpoint, available_now=True))
    done(bronze_landing.land(stream(spark, source), table, checkpoint, available_now=True))
    rows = spark.read.parquet(table)
    assert rows.count() == len(messages()) + 1
    assert rows.where("event_id is null").count() == 1
    pruned = rows.where("event_date = date '2026-03-09' and tenant_id = 'quill_ltd'")
    assert pruned.count() == 2
    assert "PartitionFilters: [isnotnull(event_date" in pruned._jdf.queryExecution().toString()


def test_landed_files_do_not_grow_with_tenants(spark, folders):
    source, table, checkpoint = folders("in"), folders("bronze"), folders("cp")
    tenants = 3 * bronze_landing.TENANT_GROUPS
    records = [
        b'{"id":"e%d","source":"s","tenant_id":"t%d","event_type":"x","livemode":false,"created":%d,'
        b'"api_version":"1","data":{"object":{}}}' % (k, k % tenants, 1767225600 + 86400 * (k // tenants))
        for k in range(2 * tenants)
    ]
    write(spark, source, records)
    done(bronze_landing.land(stream(spark, source), table, checkpoint, available_now=True))
    rows = spark.read.parquet(table)
    assert rows.count() == len(records)
    assert rows.select("tenant_id", "event_date").distinct().count() == 2 * tenants
    assert len(rows.inputFiles()) <= 2 * bronze_landing.TENANT_GROUPS
    assert "/tenant_id=" not in rows.inputFiles()[0]


@pytest.mark.parametrize("batches", [1, 4])
def test_live_kpis_over_micro_batches_equal_batch(spark, folders, batches):
    source, log, checkpoint = folders("in"), folders("log"), folders("cp")
    for part in parts(batches):
        write(spark, source, part)
        done(live_kpis.start_daily(events(spark, source), log, checkpoint))
    assert as_rows(live_kpis.current_kpis(spark.read.parquet(log))) == sorted(LIVE)


def test_running_mrr_is_carried_in_state(spark, folders):
    source, log, checkpoint = folders("in"), folders("log"), folders("cp")
    # Later days arrive first: the state must correct the totals of the days after.
    for part in reversed(parts(3)):
        write(spark, source, part)
        done(live_kpis.start_deduped(events(spark, source), folders("fresh"), folders("fresh-cp")))
        fresh = live_kpis.fresh_stream(spark, folders("fresh"))
        done(live_kpis.start_running_mrr(fresh, log, checkpoint))
    got = live_kpis.newest_wins(
        spark.read.parquet(log), ["tenant_id", "metric_date"], "batch_id"
    ).drop("batch_id")
    assert as_rows(got) == sorted(r[:3] for r in LIVE)


def test_re_deliveries_in_a_later_batch_are_dropped(spark, folders):
    source, table, checkpoint = folders("in"), folders("out"), folders("cp")
    for _ in range(2):
        write(spark, source, messages())
        done(live_kpis.start_deduped(events(spark, source), table, checkpoint))
    assert spark.read.parquet(table).count() == len(messages()) - 2


def test_nothing_is_lost_behind_an_event_from_the_future(spark, folders):
    source, log, checkpoint = folders("in"), folders("log"), folders("cp")
    import json

    future = json.dumps(
        {"id": "evt_future", "source": "stripe", "tenant_id": "zz_late", "event_type": "invoice.paid",
         "created": 4102444800, "data": {"object": {"amount": 700}}}
    ).encode()
    first, *others = parts(4)
    for part in ([future], first, *others, first[:3], [future]):
        write(spark, source, part)
        done(live_kpis.start_daily(events(spark, source), log, checkpoint))
    found = live_kpis.current_kpis(spark.read.parquet(log))
    assert as_rows(found.where("tenant_id != 'zz_late'")) == sorted(LIVE)
    assert found.where("tenant_id = 'zz_late'").count() == 1
    tenants = spark.createDataFrame([("zz_late",)], "tenant_id string")
    new = live_kpis.newcomers(spark.read.parquet(log), tenants)
    assert {r[0] for r in new.collect()} == {r[0] for r in LIVE}


def test_late_rows_are_kept(spark, folders):
    source, log, checkpoint = folders("in"), folders("log"), folders("cp")
    write(spark, source, messages())
    arrived = F.lit("2026-03-12 07:00:00").cast("timestamp")
    bronze = ingest.to_bronze(stream(spark, source)).withColumn("ingested_at", arrived)
    done(live_kpis.start_late(bronze, log, checkpoint, "2 days"))
    late = {str(r[0]): r[1] for r in live_kpis.late_by_day(spark.read.parquet(log)).collect()}
    assert late == {"2026-03-09": 14}


def test_parity_reports_missing_and_different_days(spark):
    schema = (
        "tenant_id string, metric_date string, mrr double, conversion_rate double, "
        "refund_rate double, checkout_volume double"
    )
    live = spark.createDataFrame(LIVE, schema)
    changed = [(*r[:2], r[2] + 1, *r[3:]) if i == 0 else r for i, r in enumerate(LIVE[:-1])]
    got = live_kpis.parity(live, spark.createDataFrame(changed, schema))
    assert live_kpis.parity(live, live).isEmpty()
    assert {(r["tenant_id"], r["metric_date"]) for r in got.collect()} == {
        ("harbor_co", "2026-03-09"), ("quill_ltd", "2026-03-12"),
    }
