"""Features, detection, evaluation and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql
from checks.common import day, features_of, rule_records_of, scored_of, standardised_of, with_days
from tidemark.operators import (
    attribution, classify, evaluate, features, forest, labels, ordering, series, splits,
    temporal,
)
from tidemark.plans import detection
from tidemark.schemas import LABELS, METRICS
from tidemark.sources.tables import supplied

KEY = ["tenant_id", "metric_date"]
Z = detection.Z_COLUMNS


def day_index(spark, sf_dir):
    return features_of(spark, sf_dir).select("tenant_id", day("metric_date"), "day")


def tenant_standardise(spark, sf_dir):
    return standardised_of(spark, sf_dir).select(
        "tenant_id", day("metric_date"), *[F.round(z, 6).alias(z) for z in Z]
    )


def tenant_baseline(spark, sf_dir):
    rows = features.baseline(features_of(spark, sf_dir))
    return rows.select("tenant_id", *[F.round(c, 6).alias(c) for c in rows.columns[1:]])


def tenant_stats_join(spark, sf_dir):
    rows = attribution.above(features.with_baseline(scored_of(spark, sf_dir)))
    return rows.select(
        "tenant_id", day("metric_date"),
        *[F.round(f"{m}_{s}", 6).alias(f"{m}_{s}") for m in METRICS for s in ("mean", "std")],
    )


def rolling_zscore(spark, sf_dir):
    rows = features.rolling_zscore(features_of(spark, sf_dir))
    return rows.select("tenant_id", day("metric_date"), F.round("zscore", 6).alias("zscore"))


def _order_series(spark, sf_dir):
    return supplied(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("stream"), F.col("o_orderdate").alias("ts"), "o_orderkey",
        F.col("o_totalprice").alias("value"),
    )


def rolling_zscore_series(spark, sf_dir):
    """The univariate form, 48 rows back: events by type, in short chunks so that the overlap
    is used, and orders by customer."""
    rows = series.rolling_zscore(
        _event_series(spark, sf_dir), ["ts", "event_id"], chunk_rows=500
    ).select("event_id", "zscore")
    orders = series.rolling_zscore(_order_series(spark, sf_dir), ["ts", "o_orderkey"])
    both = rows.union(orders.select(-F.col("o_orderkey") - 1, "zscore"))
    return both.select("event_id", F.round("zscore", 6).alias("zscore"))


def _event_series(spark, sf_dir):
    return supplied(spark, sf_dir, "events").select(
        F.col("event_type").alias("stream"), F.col("ts").cast("timestamp").alias("ts"),
        "event_id", "value",
    )


def ar2_series(spark, sf_dir):
    rows = series.ar2_residual(_event_series(spark, sf_dir), ["ts", "event_id"], chunk_rows=500)
    return rows.select("event_id", F.round("ar2", 4).alias("ar2"))


def series_benchmark(spark, sf_dir):
    """Four detectors per event stream, labelled by the half hours around large values, and
    their metrics averaged over the streams."""
    points = _event_series(spark, sf_dir)
    half_hour = F.expr("interval 30 minutes")
    windows = points.where("value > 300").select(
        "stream", (F.col("ts") - half_hour).alias("start"), (F.col("ts") + half_hour).alias("end")
    )
    scored = series.detector_scores(points, ["ts", "event_id"], ["event_id"])
    labelled = labels.interval_label(scored, windows).withColumnRenamed("is_anomaly", "label")
    long = evaluate.long_scores(
        labelled,
        {"ensemble": "ensemble", "forest": "forest", "zscore": "zscore", "ar2": "ar2"},
        ["stream", "label"],
    )
    return evaluate.mean_over_streams(evaluate.evaluate(long, ["stream", "method"]))


def sliding_windows(spark, sf_dir):
    rows = features.sliding_windows(features_of(spark, sf_dir), 7, METRICS)
    w = F.col("window_values")
    return rows.where(w.isNotNull()).select(
        "tenant_id", day("metric_date"), F.size(w).cast("bigint").alias("n"),
        F.round(w[0], 4).alias("oldest_mrr"), F.round(w[27], 4).alias("latest_volume"),
        F.round(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
    )


def rank_percentile(spark, sf_dir):
    return scored_of(spark, sf_dir).select("tenant_id", day("metric_date"), "score")


def warmup_backfill(spark, sf_dir):
    """Seven-day totals of the volume: the first six days take the first full total."""
    rows = features.sliding_windows(features_of(spark, sf_dir), 7, ["checkout_volume"])
    total = F.when(
        F.col("window_values").isNotNull(),
        F.aggregate("window_values", F.lit(0.0), lambda a, x: a + x),
    )
    filled = features.warmup_backfill(rows.withColumn("total", total), "total")
    return filled.select("tenant_id", day("metric_date"), "total")


def top_contributors(spark, sf_dir):
    rows = attribution.top_contributors(features.with_baseline(features_of(spark, sf_dir)))
    return rows.select(
        "tenant_id", day("metric_date"),
        *[F.col("top_contributors")[i]["metric"].alias(f"m{i + 1}") for i in range(3)],
        *[F.col("top_contributors")[i]["sd"].alias(f"s{i + 1}") for i in range(3)],
    )


def threshold_gate(spark, sf_dir):
    return attribution.above(scored_of(spark, sf_dir)).select(
        "tenant_id", day("metric_date"), "score"
    )


def describe_anomaly(spark, sf_dir):
    return rule_records_of(spark, sf_dir, 0.0).select("tenant_id", "metric_date", "description")


def isolation_forest(spark, sf_dir):
    rows = detection.with_forest(standardised_of(spark, sf_dir))
    return rows.select("tenant_id", day("metric_date"), F.round("forest", 9).alias("forest"))


def window_reconstruction(spark, sf_dir):
    rows = temporal.temporal_scores(standardised_of(spark, sf_dir))
    return rows.select("tenant_id", day("metric_date"), F.round("temporal", 9).alias("temporal"))


def ar2_residual(spark, sf_dir):
    rows = features.ar2_residual(features_of(spark, sf_dir))
    return rows.select("tenant_id", day("metric_date"), F.round("ar2", 4).alias("ar2"))


def ensemble_score(spark, sf_dir):
    rows = detection.ensemble(features_of(spark, sf_dir))
    return rows.select("tenant_id", day("metric_date"), F.round("score", 9).alias("score"))


def rank_blend(spark, sf_dir):
    """The blend arithmetic on two model-free scores: rolling z-score and AR(2) residual."""
    rows = features.ar2_residual(scored_of(spark, sf_dir)).withColumn("ar2", F.round("ar2", 4))
    ranked = ordering.rank_percentile(rows, "ar2", KEY, "ar2_rank")
    blended = detection.blend(F.col("score"), F.col("ar2_rank"), 0.5)
    return ranked.select("tenant_id", day("metric_date"), F.round(blended, 6).alias("score"))


def anomaly_records(spark, sf_dir):
    frame = features_of(spark, sf_dir)
    classifier = classify.fit(detection.training_text(frame))
    rows = detection.anomaly_records(detection.ensemble(frame), classifier)
    return rows.withColumn("top_contributors", F.to_json("top_contributors")).withColumn(
        "metrics", F.to_json("metrics")
    )


def shapley_drivers(spark, sf_dir):
    rows = standardised_of(spark, sf_dir)
    grown = forest.fit(rows, Z, KEY)
    scored = ordering.rank_percentile(forest.score(rows, grown), "forest", KEY, "score")
    return with_days(
        forest.shapley(
            attribution.above(scored), grown, KEY, forest.background_rows(rows, KEY)
        ).withColumn("shapley", F.round("shapley", 9)),
        "metric_date",
    )


# --- Evaluation: labelled documents stand in for labelled days ----------------------------


def _labelled(spark, sf_dir):
    docs, labels = supplied(spark, sf_dir, "documents"), supplied(spark, sf_dir, "labels")
    words = F.size(F.array_distinct(F.split("text", r"[ \n]")))
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col("source").alias("stream"), F.col("toxic").alias("label"),
        F.when(F.col("lang") == "en", "point").otherwise("contextual").alias("regime"),
        F.col("n_chars").alias("by_length"), words.alias("by_words"),
        (F.col("n_chars") / words).alias("by_density"),
    )


_METHODS = {"length": "by_length", "words": "by_words", "density": "by_density"}


def _scored_methods(spark, sf_dir):
    return evaluate.long_scores(
        _labelled(spark, sf_dir), _METHODS, ["doc_id", "stream", "label", "regime"]
    )


def _rounded(df, *keep, places=9):
    return df.select(*keep, *[F.round(c, places).alias(c) for c in df.columns if c not in keep])


def pr_curve(spark, sf_dir):
    points = evaluate.pr_points(_scored_methods(spark, sf_dir), ["method"])
    return points.select(
        "method", F.round("threshold", 9).alias("threshold"), "tp", "predicted",
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")],
    )


def pr_curve_best_f1(spark, sf_dir):
    rows = evaluate.evaluate(_scored_methods(spark, sf_dir), ["method"])
    return _rounded(rows.drop("pr_auc"), "method")


def average_precision(spark, sf_dir):
    rows = evaluate.evaluate(_scored_methods(spark, sf_dir), ["method"])
    return _rounded(rows.select("method", "pr_auc"), "method")


def regime_recall(spark, sf_dir):
    scored = _scored_methods(spark, sf_dir)
    rows = evaluate.regime_recall(scored, evaluate.evaluate(scored, ["method"]), ["method"])
    return _rounded(rows, "method")


def method_benchmark(spark, sf_dir):
    return _rounded(evaluate.benchmark(_scored_methods(spark, sf_dir), ["method"]), "method")


def mean_over_streams(spark, sf_dir):
    per_stream = evaluate.evaluate(_scored_methods(spark, sf_dir), ["stream", "method"])
    return _rounded(evaluate.mean_over_streams(per_stream), "method")


def weight_sweep(spark, sf_dir):
    """Blend of two rank scores over a weight grid; two stand-in window sizes."""
    rows = _labelled(spark, sf_dir)
    for column in _METHODS.values():
        rows = ordering.rank_percentile(rows, column, ["doc_id"], f"{column}_rank")
    sweep = evaluate.weight_sweep(
        rows, {5: "by_words_rank", 7: "by_density_rank"}, "by_length_rank",
        [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    )
    return sweep.select("window", "weight", F.round("pr_auc", 9).alias("pr_auc"))


def _labelled_days(spark, sf_dir):
    """Tenant-days, labelled by a refund rate above 1."""
    regime = F.when(F.col("mrr") > 0, "point").otherwise("contextual")
    return (
        features_of(spark, sf_dir)
        .withColumn("label", (F.col("refund_rate") > 1).cast("int"))
        .withColumn("regime", regime)
    )


def detector_benchmark(spark, sf_dir):
    """All four detectors on all tenant-days."""
    scored = detection.ensemble(_labelled_days(spark, sf_dir))
    long = evaluate.long_scores(
        features.ar2_residual(features.rolling_zscore(scored)),
        {"ensemble": "score", "forest": "forest", "zscore": "zscore", "ar2": "ar2"},
        [*KEY, "label", "regime"],
    )
    return evaluate.benchmark(long, ["method"])


def detector_tuning(spark, sf_dir):
    """Window and weight tuned on two thirds of the tenants, detectors compared on the others."""
    return detection.tune_and_benchmark(
        _labelled_days(spark, sf_dir), [5, 7, 10], [0.2, 0.35, 0.5, 0.65, 0.8]
    )


# --- Splits and classification ------------------------------------------------------------


def stratified_split(spark, sf_dir):
    docs = supplied(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.stratified_split(docs, "lang", "doc_id")


def template_holdout(spark, sf_dir):
    docs = supplied(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    held = splits.held_out_templates(docs, "lang", "source")
    return splits.hold_out(docs, held, "source")[1]


def tenant_split(spark, sf_dir):
    return splits.held_out_tenants(features_of(spark, sf_dir).select("tenant_id"))


def holdout_semi(spark, sf_dir):
    """Feature rows of the kept and of the held-out tenants."""
    frame = features_of(spark, sf_dir).select(*KEY)
    kept, held = splits.hold_out(frame, splits.held_out_tenants(frame), "tenant_id")
    both = kept.withColumn("part", F.lit("tune")).union(held.withColumn("part", F.lit("holdout")))
    return with_days(both, "metric_date")


def _predictions(spark, sf_dir):
    """Fixed labels by language, predictions by source; every label but one occurs."""
    names = F.array(*[F.lit(x) for x in LABELS])
    place = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).when(
        F.col("lang") == "de", 3
    ).otherwise(4)
    guess = F.length("source") % 2 + place % 3 + 1
    return supplied(spark, sf_dir, "documents").select(
        F.element_at(names, place).alias("label"), F.element_at(names, guess).alias("prediction")
    )


def class_metrics(spark, sf_dir):
    rows = evaluate.class_metrics(_predictions(spark, sf_dir))
    return rows.select(*[F.round(c, 9).alias(c) for c in rows.columns])


def class_f1(spark, sf_dir):
    rows = evaluate.class_f1(_predictions(spark, sf_dir))
    return rows.select("label", "support", "tp", F.round("f1", 9).alias("f1"))


def tfidf_features(spark, sf_dir):
    rows = classify.tfidf(supplied(spark, sf_dir, "benchmark"), "item_id")
    return rows.select("item_id", "term", "tf", F.round("weight", 9).alias("weight"))


def tfidf_documents(spark, sf_dir):
    """The same over all documents, summed per document."""
    rows = classify.tfidf(supplied(spark, sf_dir, "documents"), "doc_id")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("weight"),
        F.round(F.max("weight"), 6).alias("heaviest"),
    )


def type_classifier(spark, sf_dir):
    """Trained on the descriptions of four fifths of the tenant-days of each type; predicts
    the type of the others."""
    text = detection.training_text(features_of(spark, sf_dir)).withColumn(
        "key", F.concat_ws("|", "tenant_id", "metric_date")
    )
    parts = splits.stratified_split(text, "label", "key")
    fitted = classify.fit(parts.where(~F.col("is_test")))
    rows = classify.classify(parts.where("is_test"), fitted)
    return rows.select("key", "label", "prediction", F.round("confidence", 6).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        day_index, tenant_standardise, tenant_baseline, tenant_stats_join, rolling_zscore,
        rolling_zscore_series, ar2_series, series_benchmark, sliding_windows, rank_percentile, warmup_backfill, top_contributors,
        threshold_gate, describe_anomaly, isolation_forest, window_reconstruction, ar2_residual,
        ensemble_score, rank_blend, anomaly_records, shapley_drivers, pr_curve, pr_curve_best_f1,
        average_precision, regime_recall, method_benchmark, mean_over_streams, weight_sweep,
        detector_benchmark, detector_tuning, stratified_split, template_holdout, tenant_split, holdout_semi,
        class_metrics, class_f1, tfidf_features, tfidf_documents, type_classifier,
    )
}

_MD = "strftime(metric_date, '%Y-%m-%d') AS metric_date"


def _standard(m: str) -> str:
    std = f"stddev_pop({m}) OVER t"
    return f"round(({m} - avg({m}) OVER t) / CASE WHEN {std} = 0 THEN 1.0 ELSE {std} END, 6) AS z_{m}"


def _ar2() -> str:
    """CTEs of the AR(2) residual in plain SQL; the last is `ar`."""
    lags = ", ".join(f"lag({m}, {k}) OVER o AS {m}_{k}" for m in METRICS for k in (1, 2))
    fit = ", ".join(
        f"avg({m}) AS {m}_all, "
        f"avg({m}) FILTER ({m}_2 IS NOT NULL) AS {m}_my, "
        f"avg({m}_1) FILTER ({m}_2 IS NOT NULL) AS {m}_m1, "
        f"avg({m}_2) FILTER ({m}_2 IS NOT NULL) AS {m}_m2"
        for m in METRICS
    )
    pairs = {"11": ("1", "1"), "22": ("2", "2"), "12": ("1", "2"), "1y": ("1", "y"), "2y": ("2", "y")}

    def c(m: str, p: str) -> str:
        return f"({m} - {m}_my)" if p == "y" else f"({m}_{p} - {m}_m{p})"

    moments = ", ".join(
        f"sum({c(m, a)} * {c(m, b)}) FILTER ({m}_2 IS NOT NULL) AS {m}_s{name}"
        for m in METRICS
        for name, (a, b) in pairs.items()
    )
    residual = []
    for m in METRICS:
        det = f"({m}_s11 * {m}_s22 - {m}_s12 * {m}_s12)"
        a1 = f"({m}_s1y * {m}_s22 - {m}_s2y * {m}_s12) / {det}"
        a2 = f"({m}_s2y * {m}_s11 - {m}_s1y * {m}_s12) / {det}"
        residual.append(
            f"CASE WHEN {det} > 1e-9 * {m}_s11 * {m}_s22 THEN CASE WHEN {m}_2 IS NULL "
            f"THEN abs({m} - {m}_all) ELSE "
            f"abs({c(m, 'y')} - {a1} * {c(m, '1')} - {a2} * {c(m, '2')}) END END AS {m}_r"
        )
    score = ", ".join(
        f"coalesce(({m}_r - avg({m}_r) OVER t) / (stddev_pop({m}_r) OVER t + 1e-9), 0.0)"
        for m in METRICS
    )
    return f""",
    lagged AS (SELECT *, {lags} FROM features
      WINDOW o AS (PARTITION BY tenant_id ORDER BY metric_date)),
    means AS (SELECT tenant_id, {fit} FROM lagged GROUP BY tenant_id),
    moments AS (SELECT tenant_id, {moments} FROM lagged JOIN means USING (tenant_id)
      GROUP BY tenant_id),
    resid AS (SELECT lagged.*, {", ".join(residual)}
      FROM lagged JOIN means USING (tenant_id) JOIN moments USING (tenant_id)),
    ar AS (SELECT tenant_id, metric_date, round(greatest({score}), 4) AS ar2 FROM resid
      WINDOW t AS (PARTITION BY tenant_id))"""


_AR2 = _ar2()

_EVAL = """labelled AS (
  SELECT d.doc_id, source AS stream, toxic AS label,
    CASE WHEN lang = 'en' THEN 'point' ELSE 'contextual' END AS regime,
    n_chars AS by_length, len(list_distinct(regexp_split_to_array(text, '[ \\n]'))) AS by_words
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
long AS (
  SELECT doc_id, stream, label, regime,
    unnest(['length', 'words', 'density']) AS method,
    unnest([CAST(by_length AS DOUBLE), CAST(by_words AS DOUBLE),
            CAST(by_length AS DOUBLE) / by_words]) AS score
  FROM labelled
)"""


def _curve(by: str, source: str = "long") -> str:
    return f"""
steps AS (SELECT {by}, score, sum(label) AS hits, count(*) AS n FROM {source}
          GROUP BY {by}, score),
cum AS (SELECT *, sum(hits) OVER c AS tp, sum(n) OVER c AS predicted,
          sum(hits) OVER (PARTITION BY {by}) AS pos FROM steps
        WINDOW c AS (PARTITION BY {by} ORDER BY score DESC)),
curve AS (SELECT *, tp / CAST(predicted AS DOUBLE) AS p,
  CASE WHEN pos = 0 THEN 1.0 ELSE tp / CAST(pos AS DOUBLE) END AS r FROM cum),
pts AS (SELECT *, CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END AS f1 FROM curve),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY f1 DESC, score)
  AS rn FROM pts) WHERE rn = 1),
ap AS (SELECT {by}, sum(CASE WHEN pos = 0 THEN 0.0 ELSE hits / CAST(pos AS DOUBLE) END * p)
  AS pr_auc FROM pts GROUP BY {by})"""


_RECALL = """recalls AS (
  SELECT method, avg(CASE WHEN long.regime = 'point' THEN CAST(long.score >= b.score AS DOUBLE) END)
      AS recall_point,
    avg(CASE WHEN long.regime = 'contextual' THEN CAST(long.score >= b.score AS DOUBLE) END)
      AS recall_contextual
  FROM long JOIN best b USING (method) GROUP BY method
)"""

_PRED = """pred AS (
  SELECT names[place] AS label, names[length(source) % 2 + place % 3 + 1] AS prediction
  FROM (SELECT *, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS place,
    ['payment_failure', 'churn_spike', 'seasonal_dip', 'acquisition_drop', 'pricing_effect',
     'infrastructure_issue'] AS names FROM documents)
),
classes AS (SELECT unnest(['payment_failure', 'churn_spike', 'seasonal_dip', 'acquisition_drop',
  'pricing_effect', 'infrastructure_issue']) AS label),
per_class AS (
  SELECT c.label, (SELECT count(*) FROM pred p WHERE p.label = c.label) AS support,
    (SELECT count(*) FROM pred p WHERE p.prediction = c.label) AS guessed,
    (SELECT count(*) FROM pred p WHERE p.label = c.label AND p.prediction = c.label) AS tp
  FROM classes c
),
scored_classes AS (SELECT *, CASE WHEN support + guessed = 0 THEN 0.0
  ELSE 2.0 * tp / CAST(support + guessed AS DOUBLE) END AS f1 FROM per_class)"""


def _grams(table: str, key: str) -> str:
    return f"""
words AS (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}') AS w
  FROM {table}),
grams AS (
  SELECT {key}, unnest(w) AS term FROM words
  UNION ALL
  SELECT {key}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
  FROM words
),
tf AS (SELECT {key}, term, count(*) AS tf FROM grams GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
weighted AS (
  SELECT {key}, term, tf, tf * (ln((n + 1) / CAST(df + 1 AS DOUBLE)) + 1) AS raw
  FROM tf JOIN df USING (term), (SELECT count(*) AS n FROM {table})
),
tfidf AS (SELECT {key}, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight
  FROM weighted)"""


_STATS_COLUMNS = ", ".join(
    f"round({m}_{s}, 6) AS {m}_{s}" for m in METRICS for s in ("mean", "std")
)

ORACLE = {
    "day_index": f"WITH {sql.FEATURES} SELECT tenant_id, {_MD}, day FROM features",
    "tenant_standardise": f"""WITH {sql.FEATURES}
      SELECT tenant_id, {_MD}, {", ".join(_standard(m) for m in METRICS)} FROM features
      WINDOW t AS (PARTITION BY tenant_id)""",
    "tenant_baseline": f"""WITH {sql.FEATURES}
      SELECT tenant_id, {", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in METRICS)}
      FROM features GROUP BY tenant_id""",
    "tenant_stats_join": f"""WITH {sql.RECORDS}
      SELECT tenant_id, {_MD}, {_STATS_COLUMNS} FROM statted WHERE score >= 0.95""",
    "rolling_zscore": f"""WITH {sql.FEATURES}
      SELECT tenant_id, {_MD},
        round(greatest({", ".join(sql.rolling_z(m, "w") for m in METRICS)}), 6) AS zscore
      FROM features
      WINDOW w AS (PARTITION BY tenant_id ORDER BY features.metric_date
                   ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "rolling_zscore_series": f"""
      SELECT event_id, round({sql.rolling_z("value", "w")}, 6) AS zscore FROM events
      WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id
                   ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)
      UNION ALL
      SELECT -o_orderkey - 1, round({sql.rolling_z("o_totalprice", "w")}, 6) FROM orders
      WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                   ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)""",
    "ar2_series": """WITH lagged AS (
        SELECT event_type AS s, event_id, value AS y, lag(value, 1) OVER o AS l1,
          lag(value, 2) OVER o AS l2 FROM events
        WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id)
      ),
      fit AS (
        SELECT s, avg(y) FILTER (l2 IS NOT NULL) AS my, avg(l1) FILTER (l2 IS NOT NULL) AS m1,
          avg(l2) AS m2, avg(y) AS mean, var_pop(l1) FILTER (l2 IS NOT NULL) AS s11,
          var_pop(l2) AS s22, covar_pop(l1, l2) AS s12,
          covar_pop(l1, y) FILTER (l2 IS NOT NULL) AS s1y, covar_pop(l2, y) AS s2y
        FROM lagged GROUP BY s
      ),
      coef AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS a1,
        (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS a2 FROM fit),
      resid AS (SELECT s, event_id, abs(CASE WHEN l2 IS NULL THEN y - mean
        ELSE y - my - a1 * (l1 - m1) - a2 * (l2 - m2) END) AS r FROM lagged JOIN coef USING (s))
      SELECT event_id, round((r - avg(r) OVER w) / (stddev_pop(r) OVER w + 1e-9), 4) AS ar2
      FROM resid WINDOW w AS (PARTITION BY s)""",
    "sliding_windows": f"""WITH {sql.FEATURES}
      SELECT tenant_id, {_MD}, 28 AS n, round(lag(mrr, 6) OVER o, 4) AS oldest_mrr,
        round(checkout_volume, 4) AS latest_volume,
        round(sum(mrr + conversion_rate + refund_rate + checkout_volume) OVER w, 4) AS total
      FROM features
      WINDOW o AS (PARTITION BY tenant_id ORDER BY metric_date),
        w AS (PARTITION BY tenant_id ORDER BY metric_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
      QUALIFY row_number() OVER o >= 7""",
    "rank_percentile": f"WITH {sql.SCORED} SELECT tenant_id, {_MD}, score FROM scored",
    "warmup_backfill": f"""WITH {sql.FEATURES},
      totals AS (
        SELECT *, CASE WHEN day >= 6 THEN sum(checkout_volume) OVER (PARTITION BY tenant_id
          ORDER BY metric_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS t FROM features
      )
      SELECT tenant_id, {_MD}, coalesce(t, max(CASE WHEN day = 6 THEN t END)
        OVER (PARTITION BY tenant_id), 0.0) AS total FROM totals""",
    "top_contributors": f"""WITH {sql.RECORDS}
      SELECT tenant_id, metric_date, m1, m2, m3, s1, s2, s3 FROM records""",
    "threshold_gate": f"""WITH {sql.SCORED}
      SELECT tenant_id, {_MD}, score FROM scored WHERE score >= 0.95""",
    "describe_anomaly": f"WITH {sql.RECORDS} SELECT tenant_id, metric_date, description FROM records",
    "ar2_residual": f"WITH {sql.FEATURES} {_AR2} SELECT tenant_id, {_MD}, ar2 FROM ar",
    "rank_blend": f"""WITH {sql.SCORED} {_AR2},
      ranked AS (
        SELECT tenant_id, metric_date, s.score,
          CAST(row_number() OVER (ORDER BY ar2, tenant_id, metric_date) - 1 AS DOUBLE)
            / (count(*) OVER () - 1) AS ar2_rank
        FROM scored s JOIN ar USING (tenant_id, metric_date)
      )
      SELECT tenant_id, {_MD}, round(0.5 * score + 0.5 * ar2_rank, 6) AS score FROM ranked""",
    "pr_curve": f"""WITH {_EVAL}, {_curve("method")}
      SELECT method, round(score, 9) AS threshold, CAST(tp AS BIGINT) AS tp,
        CAST(predicted AS BIGINT) AS predicted, round(p, 9) AS precision, round(r, 9) AS recall,
        round(f1, 9) AS f1 FROM pts""",
    "pr_curve_best_f1": f"""WITH {_EVAL}, {_curve("method")}
      SELECT method, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1,
        round(score, 9) AS threshold FROM best""",
    "average_precision": f"""WITH {_EVAL}, {_curve("method")}
      SELECT method, round(pr_auc, 9) AS pr_auc FROM ap""",
    "regime_recall": f"""WITH {_EVAL}, {_curve("method")}, {_RECALL}
      SELECT method, round(recall_point, 9) AS recall_point,
        round(recall_contextual, 9) AS recall_contextual FROM recalls""",
    "method_benchmark": f"""WITH {_EVAL}, {_curve("method")}, {_RECALL}
      SELECT method, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1,
        round(pr_auc, 9) AS pr_auc, round(score, 9) AS threshold,
        round(recall_point, 9) AS recall_point, round(recall_contextual, 9) AS recall_contextual
      FROM best JOIN ap USING (method) JOIN recalls USING (method)""",
    "mean_over_streams": f"""WITH {_EVAL}, {_curve("stream, method")}
      SELECT method, round(avg(p), 9) AS precision, round(avg(r), 9) AS recall,
        round(avg(f1), 9) AS f1, round(avg(pr_auc), 9) AS pr_auc
      FROM best JOIN ap USING (stream, method) GROUP BY method""",
    "weight_sweep": f"""WITH {_EVAL},
      ranked AS (
        SELECT label,
          (row_number() OVER (ORDER BY CAST(by_length AS DOUBLE), doc_id) - 1)
            / CAST(count(*) OVER () - 1 AS DOUBLE) AS lr,
          (row_number() OVER (ORDER BY by_words, doc_id) - 1)
            / CAST(count(*) OVER () - 1 AS DOUBLE) AS wr,
          (row_number() OVER (ORDER BY CAST(by_length AS DOUBLE) / by_words, doc_id) - 1)
            / CAST(count(*) OVER () - 1 AS DOUBLE) AS dr
        FROM labelled
      ),
      weights AS (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS weight),
      trials AS (
        SELECT label, 5 AS "window", weight, weight * wr + (1.0::DOUBLE - weight) * lr AS score
        FROM ranked, weights
        UNION ALL
        SELECT label, 7, weight, weight * dr + (1.0::DOUBLE - weight) * lr FROM ranked, weights
      ), {_curve('"window", weight', "trials")}
      SELECT "window", weight, round(pr_auc, 9) AS pr_auc FROM ap""",
    "stratified_split": """
      SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|0'), doc_id)
        <= floor(count(*) OVER (PARTITION BY lang) * 0.2::DOUBLE) AS is_test
      FROM documents""",
    "template_holdout": """WITH t AS (SELECT DISTINCT lang, source FROM documents),
      held AS (SELECT DISTINCT source FROM (
        SELECT source, row_number() OVER (PARTITION BY lang ORDER BY md5(source || '|0'), source)
          AS rn FROM t) WHERE rn <= 2)
      SELECT source, doc_id, lang FROM documents WHERE source IN (SELECT source FROM held)""",
    "tenant_split": f"""WITH {sql.FEATURES},
      t AS (SELECT DISTINCT tenant_id FROM features)
      SELECT tenant_id FROM t
      QUALIFY row_number() OVER (ORDER BY md5(tenant_id || '|0'), tenant_id)
        <= greatest(1, floor(count(*) OVER () * 0.33::DOUBLE))""",
    "holdout_semi": f"""WITH {sql.FEATURES},
      t AS (SELECT DISTINCT tenant_id FROM features),
      held AS (SELECT tenant_id FROM t
        QUALIFY row_number() OVER (ORDER BY md5(tenant_id || '|0'), tenant_id)
          <= greatest(1, floor(count(*) OVER () * 0.33::DOUBLE)))
      SELECT tenant_id, {_MD}, CASE WHEN tenant_id IN (SELECT tenant_id FROM held)
        THEN 'holdout' ELSE 'tune' END AS part FROM features""",
    "class_metrics": f"""WITH {_PRED}
      SELECT round((SELECT avg(CAST(label = prediction AS DOUBLE)) FROM pred), 9) AS accuracy,
        round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1
      FROM scored_classes""",
    "class_f1": f"""WITH {_PRED}
      SELECT label, support, tp, round(f1, 9) AS f1 FROM scored_classes""",
    "tfidf_features": f"""WITH {_grams("benchmark", "item_id")}
      SELECT item_id, term, tf, round(weight, 9) AS weight FROM tfidf""",
    "tfidf_documents": f"""WITH {_grams("documents", "doc_id")}
      SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS weight,
        round(max(weight), 6) AS heaviest FROM tfidf GROUP BY doc_id""",
}
