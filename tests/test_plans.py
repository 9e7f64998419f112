"""The physical plans that matter at scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as registered
from checks import common

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    "gold_kpis daily_kpi live_daily_kpi dedupe_first tenant_standardise rolling_zscore "
    "ar2_residual request_rate rate_limit interval_label bm25_rank tfidf_documents "
    "kpi_history_all template_holdout".split(),
)
def test_no_products_and_no_single_partition(spark, name):
    text = plan(registered.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text
    for line in text.splitlines():
        if "BroadcastNestedLoopJoin" in line:  # only one-row sides: corpus size, mean idf
            assert name in ("bm25_rank", "tfidf_documents")
        if "SinglePartition" in line:
            assert name in ("bm25_rank", "tfidf_documents")


def test_gold_shuffles_narrow_rows_three_times(spark, tmp_path):
    from tidemark.plans import medallion
    from tidemark.sources import event_feed, sinks, tables

    path = str(tmp_path / "bronze")
    sinks.write_bronze(event_feed.bronze(spark, SF_DIR), path)
    text = plan(medallion.gold_from_bronze(tables.read_gold(spark, path)))
    assert text.count("Exchange hashpartitioning") == 3  # event id, tenant-day, tenant
    assert text.count("WindowGroupLimit") == 2
    assert "StructField(amount" in text and "StructField(customer" not in text
    assert "api_version" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(registered.queries()["rate_limit"](spark, SF_DIR))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>", text)
    docs = plan(registered.queries()["class_f1"](spark, SF_DIR))
    assert "ReadSchema: struct<lang:string,source:string>" in docs


def test_per_tenant_features_share_one_shuffle(spark):
    frame = common.features_of(spark, SF_DIR)
    before = plan(frame).count("Exchange")
    from tidemark.operators import features

    after = plan(features.ar2_residual(features.rolling_zscore(features.standardise(frame))))
    assert after.count("Exchange") == before
