"""Ids by date in merged runs: nothing lost or doubled, however often a batch comes."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.session import names_in
from tidemark.streaming import id_log, live_kpis

SCHEMA = live_kpis._KEPT


def events(spark, ids):
    """Ids are dated by their number; every eleventh has no date."""
    rows = []
    for k in ids:
        day = None if k % 11 == 0 else dt.date(2026, 3, 1) + dt.timedelta(days=k % 2)
        rows.append((f"e{k}", "t", "x", None, "1", day))
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


@pytest.fixture
def small_runs(monkeypatch):
    monkeypatch.setattr(id_log, "FANOUT", 3)
    add = id_log.add
    monkeypatch.setattr(id_log, "add", lambda rows, log, n: add(rows, log, n, fanout=3))


def test_many_batches_keep_few_runs_and_every_id_once(spark, tmp_path, small_runs):
    rng, table, sent, most = random.Random(1), str(tmp_path / "t"), set(), 0
    for batch in range(24):
        ids = [rng.randrange(400) for _ in range(30)]
        fresh = live_kpis.keep_fresh(events(spark, ids), table, batch)
        assert {r["event_id"] for r in fresh.collect()} == {f"e{k}" for k in set(ids) - sent}
        sent |= set(ids)
        for part in ("ids", "sketch"):
            for folder in names_in(spark, f"{table}.ids/{part}"):
                if folder.startswith("event_date"):
                    own = f"{table}.ids/{part}"
                    most = max(most, len(id_log.runs(spark, own, folder)), len(names_in(spark, f"{own}/{folder}")))
    assert most <= 2 * 3  # two runs of each of the levels that 24 batches reach
    kept = spark.read.schema(SCHEMA).parquet(table)
    assert kept.count() == len(sent) == kept.select("event_id").distinct().count()


def test_only_dates_with_a_possible_id_are_read(spark, tmp_path):
    table = str(tmp_path / "t")
    live_kpis.keep_fresh(events(spark, range(1, 10)), table, 0)
    log, march = f"{table}.ids", [dt.date(2026, 3, 1), dt.date(2026, 3, 2)]
    ask = lambda ids: id_log.possible_dates(events(spark, ids), log, march)
    assert ask([101, 102]) == [] and ask([2, 103]) == march[:1] and ask([2, 3]) == march
    assert id_log.held_ids(events(spark, [101]), log) is None
    read = {r[0] for r in id_log.held_ids(events(spark, [2, 103]), log).collect()}
    assert read == {"e2", "e4", "e6", "e8"}
    # A sketch of few bits answers "maybe" for everything, and nothing is lost by it.
    full = str(tmp_path / "full")
    id_log.add(events(spark, range(1, 10)), full, 0, bits=2)
    assert id_log.possible_dates(events(spark, [101, 102]), full, march, bits=2) == march
    empty = id_log.held_ids(events(spark, [1]).where("false"), log)
    assert empty is None


def test_batches_that_died_are_repeated_without_harm(spark, tmp_path, small_runs):
    table = str(tmp_path / "t")
    for batch in range(3):
        live_kpis.keep_fresh(events(spark, range(20 * batch, 20 * batch + 20)), table, batch)
    again = live_kpis.keep_fresh(events(spark, range(40, 60)), table, 2)  # died after the merge
    assert again.count() == 20
    part, folder = f"{table}.ids/ids", "event_date=2026-03-01"
    assert [r[:3] for r in id_log.runs(spark, part, folder)] == [(1, 0, 2)]
    # A merge that died has no marker: the runs it was made of stay in force.
    live_kpis.keep_fresh(events(spark, range(60, 80)), table, 3)
    spark.createDataFrame([("half",)], "event_id string").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(f"{part}/{folder}/run=L2-0-3")
    assert [r[:3] for r in id_log.runs(spark, part, folder)] == [(0, 3, 3), (1, 0, 2)]
    assert live_kpis.keep_fresh(events(spark, range(80)), table, 4).count() == 0
    nulls = events(spark, [200]).withColumn("event_id", F.lit(None).cast("string"))
    assert live_kpis.keep_fresh(nulls, table, 5).count() == 1
