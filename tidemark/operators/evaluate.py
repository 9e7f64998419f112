"""Detector and classifier evaluation as grouped aggregates.

Scores are first reduced to one row per distinct score; the curve is a running sum over
those rows, which may be as many as the table has, so it uses the range-partitioned form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import join_small
from tidemark.operators.ordering import running_sums
from tidemark.schemas import LABELS


def long_scores(
    rows: DataFrame, methods: dict[str, str], keep: list[str], key: str = "method"
) -> DataFrame:
    """Score columns → one row per (row, method): ``{method: column}``."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias(key), F.col(column).cast("double").alias("score"))
            for name, column in methods.items()
        ]
    )
    return rows.select(*keep, F.explode(pairs).alias("_s")).select(
        *keep, F.col(f"_s.{key}").alias(key), F.col("_s.score").alias("score")
    )


def pr_points(scored: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Precision, recall and F1 of predicting score ≥ threshold, per distinct score.

    Runs one job. Without positives recall is 1 by convention.
    """
    steps = scored.groupBy(*by, "score").agg(
        F.sum(label).cast("bigint").alias("hits"), F.count(F.lit(1)).alias("rows")
    )
    curve = running_sums(
        steps,
        {"tp": "hits", "predicted": "rows"},
        [F.col("score").desc()],
        by,
        totals={"positives": "hits"},
    )
    precision = F.col("tp").cast("double") / F.col("predicted")
    recall = F.when(F.col("positives") == 0, F.lit(1.0)).otherwise(
        F.try_divide(F.col("tp").cast("double"), F.col("positives"))
    )
    both = F.col("precision") + F.col("recall")
    return (
        curve.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f1",
            F.when(both > 0, F.lit(2.0) * F.col("precision") * F.col("recall") / both).otherwise(
                F.lit(0.0)
            ),
        )
        .select(*by, F.col("score").alias("threshold"), "hits", "positives",
                "tp", "predicted", "precision", "recall", "f1")
    )


def average_precision() -> Column:
    """Σ (recall step) · precision over the curve points."""
    step = F.coalesce(
        F.try_divide(F.col("hits").cast("double"), F.col("positives")), F.lit(0.0)
    )
    return F.sum(step * F.col("precision"))


def summarise(points: DataFrame, by: list[str]) -> DataFrame:
    """Best-F1 point (lowest threshold on ties) and average precision per group."""
    best = F.max_by(
        F.struct("precision", "recall", "f1", "threshold"),
        F.struct(F.col("f1"), (-F.col("threshold")).alias("low")),
    )
    return (
        points.groupBy(*by)
        .agg(best.alias("best"), average_precision().alias("pr_auc"))
        .select(*by, "best.precision", "best.recall", "best.f1", "pr_auc", "best.threshold")
    )


def evaluate(scored: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    return summarise(pr_points(scored, by, label), by)


def regime_recall(scored: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Share of point and of contextual rows at or above the group's threshold; NULL if none.

    The thresholds are one row per group while a group may hold most rows, so they are
    broadcast when their counted size allows it.
    """

    def share(regime: str) -> Column:
        hit = (F.col("score") >= F.col("threshold")).cast("double")
        return F.avg(F.when(F.col("regime") == regime, hit))

    return (
        join_small(scored, thresholds.select(*by, "threshold"), by)
        .groupBy(*by)
        .agg(
            share("point").alias("recall_point"),
            share("contextual").alias("recall_contextual"),
        )
    )


def benchmark(scored: DataFrame, by: list[str]) -> DataFrame:
    """Evaluation plus recall by regime, best F1 first."""
    table = evaluate(scored, by)
    return table.join(regime_recall(scored, table, by), by).orderBy(F.desc("f1"), *by)


def mean_over_streams(per_stream: DataFrame) -> DataFrame:
    """Each metric averaged over streams per method, best average precision first."""
    metrics = ["precision", "recall", "f1", "pr_auc"]
    return (
        per_stream.groupBy("method")
        .agg(*[F.avg(m).alias(m) for m in metrics])
        .orderBy(F.desc("pr_auc"), "method")
    )


def weight_sweep(
    scored: DataFrame,
    temporal: dict[int, str],
    forest: str,
    weights: list[float],
    label: str = "label",
) -> DataFrame:
    """Average precision of each (window, weight) blend of two rank scores.

    ``temporal`` names the rank column per window size. The grid is a parameter, so rows are
    multiplied by its length and no more.
    """
    grid = F.array(
        *[
            F.struct(
                F.lit(window).alias("window"),
                F.lit(weight).alias("weight"),
                (
                    F.lit(weight) * F.col(column) + F.lit(1.0 - weight) * F.col(forest)
                ).alias("score"),
            )
            for window, column in temporal.items()
            for weight in weights
        ]
    )
    trials = scored.select(label, F.explode(grid).alias("t")).select(
        label, F.col("t.window").alias("window"), F.col("t.weight").alias("weight"),
        F.col("t.score").alias("score"),
    )
    points = pr_points(trials, ["window", "weight"], label)
    return points.groupBy("window", "weight").agg(average_precision().alias("pr_auc"))


def best_trial(sweep: DataFrame) -> DataFrame:
    """The grid point with the highest average precision; smallest window and weight on ties."""
    return sweep.orderBy(F.desc("pr_auc"), "window", "weight").limit(1)


def class_f1(predictions: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Per fixed label: support, true positives, F1 (0 where undefined), and the row count.

    One aggregate over the predictions; labels that never occur still get a row.
    """
    truth, guess = F.col("label"), F.col("prediction")
    sums = [F.count(F.lit(1)).alias("rows"), F.count_if(truth == guess).alias("correct")]
    for i, name in enumerate(labels):
        sums += [
            F.count_if((truth == name) & (guess == name)).alias(f"tp{i}"),
            F.count_if(truth == name).alias(f"support{i}"),
            F.count_if(guess == name).alias(f"predicted{i}"),
        ]
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("label"),
                F.col(f"support{i}").alias("support"),
                F.col(f"tp{i}").alias("tp"),
                F.coalesce(
                    F.try_divide(
                        F.lit(2.0) * F.col(f"tp{i}"), F.col(f"support{i}") + F.col(f"predicted{i}")
                    ),
                    F.lit(0.0),
                ).alias("f1"),
            )
            for i, name in enumerate(labels)
        ]
    )
    return (
        predictions.agg(*sums)
        .select("rows", "correct", F.explode(lines).alias("l"))
        .select("l.*", "rows", "correct")
    )


def class_metrics(predictions: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Accuracy, macro F1 and weighted F1 over the fixed labels."""
    return class_f1(predictions, labels).agg(
        F.coalesce(F.try_divide(F.max("correct").cast("double"), F.max("rows")), F.lit(0.0))
        .alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.coalesce(
            F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)
        ).alias("weighted_f1"),
    )
