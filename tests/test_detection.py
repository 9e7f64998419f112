from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import (
    attribution, classify, evaluate, features, forest, labels, ordering, series, splits,
)
from tidemark.plans import detection
from tidemark.schemas import LABELS, METRICS


def synthetic(tenants=6, days=60, seed=3) -> pd.DataFrame:
    """Weekly patterns with noise, a few spikes and one sustained drop per tenant."""
    rng = np.random.default_rng(seed)
    out = []
    for t in range(tenants):
        base = np.array([rng.uniform(1e3, 1e5), 0.3, 0.03, rng.uniform(100, 900)])
        start = int(rng.integers(20, days - 8))
        spikes = set(rng.choice(np.r_[8 : start - 1, start + 6 : days], 3, replace=False))
        for d in range(days):
            season = 1 + 0.1 * math.sin(2 * math.pi * d / 7)
            values = base * season * rng.normal(1, 0.02, 4)
            regime = ""
            if d in spikes:
                values = values * np.array([0.5, 0.4, 5.0, 0.3])
                regime = "point"
            elif start <= d < start + 5:
                values = values * np.array([0.85, 0.8, 1.5, 0.75])
                regime = "contextual"
            out.append(
                (f"t{t}", dt.date(2026, 1, 1) + dt.timedelta(days=d), *map(float, values),
                 int(regime != ""), regime)
            )
    return pd.DataFrame(
        out, columns=["tenant_id", "metric_date", *METRICS, "label", "regime"]
    )


@pytest.fixture(scope="module")
def frame(spark):
    return features.day_index(spark.createDataFrame(synthetic()))


@pytest.fixture(scope="module")
def scored(frame):
    return features.ar2_residual(features.rolling_zscore(detection.ensemble(frame))).toPandas()


def test_ensemble_separates_anomalies(scored):
    assert scored["score"].between(0, 1).all()
    odd = scored["label"] == 1
    assert scored.loc[odd, "score"].mean() > scored.loc[~odd, "score"].mean() + 0.1


def test_benchmark_reaches_its_floor(spark, scored):
    long = evaluate.long_scores(
        spark.createDataFrame(scored),
        {"ensemble": "score", "forest": "forest", "zscore": "zscore", "ar2": "ar2"},
        ["label", "regime"],
    )
    table = {r["method"]: r for r in evaluate.benchmark(long, ["method"]).collect()}
    assert table["ensemble"]["pr_auc"] > 0.4
    assert all(0 <= r["f1"] <= 1 and r["recall_point"] is not None for r in table.values())


def test_forest_is_reproducible_and_orders_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 2))
    x[:5] += 9
    df = spark.createDataFrame(
        [(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double"
    )
    grown = forest.fit(df, ["a", "b"], ["id"], trees=50)
    assert len(grown.roots) == 50 and grown.sample == 256
    first = forest.score(df, grown).toPandas().set_index("id")["forest"]
    again = forest.score(df, forest.fit(df.repartition(3), ["a", "b"], ["id"], trees=50))
    assert np.allclose(first.sort_index(), again.toPandas().set_index("id")["forest"].sort_index())
    assert set(first.nlargest(5).index) == set(range(5))
    assert ((first > 0) & (first < 1)).all()


def test_forest_on_constant_and_tiny_tables(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(3)], "id long, a double")
    got = forest.score(df, forest.fit(df, ["a"], ["id"], trees=5)).toPandas()
    assert got["forest"].nunique() == 1


def test_shapley_values_add_up(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(
        [(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(300, 3)))],
        "id long, a double, b double, c double",
    )
    grown = forest.fit(df, ["a", "b", "c"], ["id"], trees=20)
    background = forest.background_rows(df, ["id"], 20)
    target = df.where("id < 5")
    parts = forest.shapley(target, grown, ["id"], background, top_k=3).toPandas()
    score = forest.score(target, grown).toPandas().set_index("id")["forest"]
    mean = forest.score(background, grown).toPandas()["forest"].mean()
    total = parts.groupby("id")["shapley"].sum()
    assert np.allclose(total, score.sort_index() - mean)
    assert (parts.groupby("id")["shapley"].apply(lambda s: s.abs().is_monotonic_decreasing)).all()


def test_ar2_matches_least_squares(spark):
    rng = np.random.default_rng(5)
    y = [0.0, 1.0]
    for _ in range(80):
        y.append(0.4 * y[-1] - 0.3 * y[-2] + rng.normal())
    pdf = pd.DataFrame(
        {"tenant_id": "t", "metric_date": pd.date_range("2026-01-01", periods=len(y)).date, "m": y}
    )
    frame = spark.createDataFrame(pdf.assign(n=1.0))
    got = features.ar2_residual(frame, ["m", "n"]).orderBy("metric_date").toPandas()["ar2"]
    a = np.c_[np.ones(len(y) - 2), y[1:-1], y[:-2]]
    coef, *_ = np.linalg.lstsq(a, np.array(y[2:]), rcond=None)
    resid = np.abs(np.r_[np.array(y[:2]) - np.mean(y), np.array(y[2:]) - a @ coef])
    z = (resid - resid.mean()) / (resid.std() + 1e-9)
    assert np.allclose(got, np.maximum(z, 0.0))  # the constant metric is singular and scores 0


def test_rolling_zscore_matches_pandas(frame):
    got = features.rolling_zscore(frame).toPandas().sort_values(["tenant_id", "day"])
    for _, g in got.groupby("tenant_id"):
        parts = []
        for m in METRICS:
            s = g[m]
            std = s.rolling(7, min_periods=1).std().fillna(1.0).replace(0.0, 1.0)
            parts.append(((s - s.rolling(7, min_periods=1).mean()) / std).abs())
        assert np.allclose(np.max(parts, axis=0), g["zscore"])


def test_short_series_have_no_windows_and_score_zero(spark):
    pdf = synthetic(2, 40).query("tenant_id == 't0' or metric_date < @cut", local_dict={
        "cut": dt.date(2026, 1, 4)})
    rows = features.day_index(spark.createDataFrame(pdf))
    got = detection.ensemble(rows, trees=20).toPandas()
    assert (got.loc[got["tenant_id"] == "t1", "temporal"] == 0).all()
    first = got[(got["tenant_id"] == "t0") & (got["day"] < 7)]["temporal"]
    assert first.nunique() == 1 and first.iloc[0] > 0


def test_rank_with_a_value_holding_a_third_of_all_rows(spark):
    df = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("s")
    ).checkpoint()
    got = ordering.rank_percentile(df, "s", ["id"], "p").toPandas().sort_values(["s", "id"])
    assert np.allclose(got["p"], np.arange(9000) / 8999)


def test_grouped_rank_and_running_sums(spark):
    df = spark.range(5000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"),
        F.hash("id").alias("v"),
    )
    got = ordering.ranked(df, [F.col("v"), F.col("id")], ["g"]).toPandas()
    got = got.sort_values(["g", "v", "id"])
    assert (got["rank"] == got.groupby("g").cumcount()).all()
    assert (got["total"] == got.groupby("g")["id"].transform("size")).all()
    sums = ordering.running_sums(df, {"c": "id"}, [F.col("v"), F.col("id")], ["g"]).toPandas()
    sums = sums.sort_values(["g", "v", "id"])
    assert (sums["c"] == sums.groupby("g")["id"].cumsum()).all()


def test_single_row_ranks_zero(spark):
    df = spark.createDataFrame([(1, 0.3)], "id long, s double")
    assert ordering.rank_percentile(df, "s", ["id"], "p").first()["p"] == 0.0


@pytest.mark.parametrize(
    ("marks", "scores", "expected"),
    [
        ([0, 0, 1, 0, 1], [0.1, 0.2, 0.9, 0.15, 0.95], (1.0, 1.0, 1.0, 1.0, 0.9)),
        ([0, 0], [0.3, 0.6], (0.0, 1.0, 0.0, 0.0, 0.3)),
        ([1, 0, 1, 0], [0.5, 0.5, 0.5, 0.5], (0.5, 1.0, 2 / 3, 0.5, 0.5)),
    ],
)
def test_evaluation_examples(spark, marks, scores, expected):
    df = spark.createDataFrame(
        [("m", y, s) for y, s in zip(marks, scores, strict=True)],
        "method string, label int, score double",
    )
    r = evaluate.evaluate(df, ["method"]).first()
    got = (r["precision"], r["recall"], r["f1"], r["pr_auc"], r["threshold"])
    assert got == pytest.approx(expected)


def test_interval_ends_are_inclusive_and_overlaps_count_once(spark):
    hour = dt.datetime(2026, 1, 1)
    points = spark.createDataFrame(
        [("s", hour + dt.timedelta(hours=h)) for h in range(4)], "stream string, ts timestamp"
    )
    windows = spark.createDataFrame(
        [("s", hour + dt.timedelta(hours=1.5), hour + dt.timedelta(hours=2.5)),
         ("s", hour + dt.timedelta(hours=2), hour + dt.timedelta(hours=2)),
         ("other", hour, hour + dt.timedelta(days=400))],
        "stream string, start timestamp, end timestamp",
    )
    got = labels.interval_label(points, windows).orderBy("ts").toPandas()
    assert list(got["is_anomaly"]) == [0, 0, 1, 0]


def test_records_carry_sorted_contributors_and_text(spark, frame, scored):
    rows = spark.createDataFrame(scored[["tenant_id", "metric_date", *METRICS, "score"]])
    classifier = classify.fit(detection.training_text(frame))
    got = detection.anomaly_records(rows, classifier).toPandas()
    assert len(got) and got["anomaly_score"].is_monotonic_decreasing
    assert set(got["anomaly_type"]) <= set(LABELS)
    assert got["type_confidence"].between(0, 1).all()
    for contributors in got["top_contributors"]:
        sizes = [abs(c["sd"]) for c in contributors]
        assert len(sizes) == 3 and sizes == sorted(sizes, reverse=True)


def test_refund_spike_is_described(spark):
    days = [(f"2026-01-{d:02d}", 1000.0, 0.3, 0.02, 500.0) for d in range(1, 15)]
    days.append(("2026-01-15", 1000.0, 0.3, 0.4, 500.0))
    df = spark.createDataFrame(
        [("t", *d, 1.0 if d[3] > 0.1 else 0.0) for d in days],
        "tenant_id string, metric_date string, mrr double, conversion_rate double, "
        "refund_rate double, checkout_volume double, score double",
    )
    r = attribution.flagged_records(df).first()
    assert r["description"].startswith("Refund rate climbed to 40.0%, well above normal.")
    assert r["top_contributors"][0]["metric"] == "refund_rate"


def test_classifier_learns_and_scores_perfect_predictions(spark, frame):
    text = detection.training_text(frame).withColumn("key", F.concat("tenant_id", "metric_date"))
    parts = splits.stratified_split(text, "label", "key")
    fitted = classify.fit(parts.where("not is_test"))
    held = classify.classify(parts.where("is_test").select("text", "label"), fitted)
    assert evaluate.class_metrics(held).first()["accuracy"] > 0.7
    perfect = spark.createDataFrame([(x, x) for x in LABELS], "label string, prediction string")
    r = evaluate.class_metrics(perfect).first()
    assert (r["accuracy"], r["macro_f1"], r["weighted_f1"]) == (1.0, 1.0, 1.0)


def test_classifier_keeps_every_term_of_its_bounded_rows(spark):
    df = spark.createDataFrame(
        [(f"alpha beta {i} word{i % 40}", "a") for i in range(60)]
        + [(f"gamma delta {i} word{i % 40}", "b") for i in range(60)],
        "text string, label string",
    )
    fitted = classify.fit(df)
    got = classify.classify(df, fitted)
    assert got.where("prediction = label").count() > 100
    assert {"alpha", "word1", "alpha beta"} <= set(fitted.counter.vocabulary)
    few = classify.fit(df, training_rows=20)
    assert len(few.counter.vocabulary) < len(fitted.counter.vocabulary)


def test_split_sizes(spark):
    df = spark.range(1000).select(
        "id", F.when(F.col("id") < 700, "a").otherwise("b").alias("label")
    )
    got = splits.stratified_split(df, "label", "id").where("is_test").groupBy("label").count()
    assert {r["label"]: r["count"] for r in got.collect()} == {"a": 140, "b": 60}
    tenants = df.select(F.col("id").cast("string").alias("tenant_id"))
    assert splits.held_out_tenants(tenants.limit(2)).count() == 1
    assert splits.held_out_tenants(tenants).count() == 330


def test_weight_sweep_prefers_the_informative_score(spark):
    df = spark.range(200).select(
        (F.col("id") >= 180).cast("int").alias("label"),
        (F.col("id") / 199).alias("good"),
        F.rand(2).alias("noise"),
    )
    sweep = evaluate.weight_sweep(df, {7: "good"}, "noise", [0.2, 0.5, 0.8])
    assert evaluate.best_trial(sweep).first()["weight"] == 0.8


def univariate(n=900, seed=9) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    out = []
    for stream in ("a", "b"):
        values = rng.normal(50, 1, n)
        values[600:605] += 25
        for i, v in enumerate(values):
            ts = dt.datetime(2026, 1, 1) + dt.timedelta(minutes=5 * i)
            out.append((stream, ts, i, float(v), int(600 <= i < 605)))
    return pd.DataFrame(out, columns=["stream", "ts", "id", "value", "label"])


def test_chunked_series_equal_whole_series(spark):
    pdf = univariate(300)
    df = spark.createDataFrame(pdf)
    got = series.rolling_zscore(df, ["ts"], 48, chunk_rows=60).toPandas()
    got = got.sort_values(["stream", "ts"])
    assert len(got) == len(pdf)
    for _, g in got.groupby("stream"):
        s = g["value"]
        std = s.rolling(48, min_periods=1).std().fillna(1.0).replace(0.0, 1.0)
        assert np.allclose(g["zscore"], ((s - s.rolling(48, min_periods=1).mean()) / std).abs())
    whole = series.ar2_residual(df, ["ts"]).toPandas().set_index(["stream", "id"])["ar2"]
    parts = series.ar2_residual(df, ["ts"], chunk_rows=7).toPandas()
    assert np.allclose(whole.sort_index(), parts.set_index(["stream", "id"])["ar2"].sort_index())
    with pytest.raises(ValueError, match="overlap"):
        series.rolling_zscore(df, ["ts"], 48, chunk_rows=40)


def test_spike_in_a_univariate_stream_is_found(spark):
    df = spark.createDataFrame(univariate())
    scored = series.detector_scores(df, ["ts"], ["stream", "id"], window=12, trees=50)
    long = evaluate.long_scores(
        scored, {"ensemble": "ensemble", "forest": "forest"}, ["stream", "label"]
    )
    table = evaluate.evaluate(long, ["stream", "method"]).toPandas()
    assert (table["pr_auc"] > 0.5).all()


def test_forests_per_stream_use_their_own_scale(spark, monkeypatch):
    monkeypatch.setattr(forest, "PARTS_AT_ONCE", 2)
    rng = np.random.default_rng(2)
    rows = [(k, i, float(rng.normal(c, 1))) for k, c in (("x", 0), ("y", 1000)) for i in range(300)]
    rows += [("x", 999, 30.0), ("y", 999, 1030.0)]
    df = spark.createDataFrame(rows, "stream string, id long, value double")
    got = forest.fit_score_parts(df, "stream", ["value"], ["stream", "id"], trees=40).toPandas()
    assert len(got) == len(rows)
    assert set(got.sort_values("forest").groupby("stream").tail(1)["id"]) == {999}


def test_tfidf_takes_texts_apart_once_and_counts_a_key_together(spark):
    texts = [(1, "Ab cd ab"), (1, "ab cd"), (2, None), (3, ""), (4, "cd ab cd ef"), (None, "ab zz")]
    rows = classify.tfidf(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id")
    assert "regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()
    tf = {(r["doc_id"], r["term"]): r["tf"] for r in rows.collect()}
    assert tf == {
        (1, "ab"): 3, (1, "cd"): 2, (1, "ab cd"): 2, (1, "cd ab"): 1,
        (4, "ab"): 1, (4, "cd"): 2, (4, "ab cd"): 1, (4, "cd ab"): 1, (None, "ab"): 1,
    }


def test_gram_counts_do_not_depend_on_the_batches():
    rows = [(1, ["a", "b", "a"]), (1, ["b", "a"]), (2, None), (2, ["a"]), (3, []), (4, ["c"] * 5), (None, ["a", "b"])]
    made = []
    for size in (1, 2, len(rows)):
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.list_(pa.string()))],
                names=["key", "_words"],
            )
            for part in (rows[i : i + size] for i in range(0, len(rows), size))
        ]
        found = [row for batch in classify._by_key(iter(batches)) for row in batch.to_pylist()]
        made.append([(r["key"], dict(zip(r["terms"], r["tf"], strict=True))) for r in found])
    assert made[0] == made[1] == made[2] == [
        (1, {"a": 3, "b": 2, "a b": 1, "b a": 2}), (2, {"a": 1}), (3, {}), (4, {"c": 5, "c c": 4}),
        (None, {"a": 1, "b": 1, "a b": 1}),
    ]


def test_training_rows_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(classify, "SPREAD_ROWS", 30)
    rows = spark.createDataFrame([(f"text {i}", f"l{i % 3}") for i in range(100)], "text string, label string")
    chosen = classify._chosen_rows(rows, 80)
    assert chosen.rdd.getNumPartitions() == 3
    first = rows.orderBy(F.xxhash64("text", "label"), "text").limit(80)
    assert sorted(chosen.collect()) == sorted(first.collect())
    assert classify._chosen_rows(rows, 20).rdd.getNumPartitions() == 1
