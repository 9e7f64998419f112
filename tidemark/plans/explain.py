"""Records → retrieved context → explanation → grounding check → alert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import numbers
from tidemark.functions.text import alert_text, grounded_explanation, search_query
from tidemark.operators import grounding, retrieval
from tidemark.operators.joins import join_small
from tidemark.session import cut_lineage


def with_query(records: DataFrame) -> DataFrame:
    """Adds ``query_id`` (hash of the record key) and the retrieval query."""
    return records.withColumn(
        "query_id", F.xxhash64("tenant_id", "metric_date", "anomaly_type")
    ).withColumn(
        "query",
        search_query(F.col("anomaly_type"), F.col("top_contributors"), F.col("description")),
    )


def with_context(records: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Adds ``context``: the k retrieved documents (id, text, its numbers) in rank order.

    Few distinct queries are asked: equal query texts are searched once. The search result is
    k rows per query; while that is small the corpus is filtered by it without a shuffle.
    """
    asked = records.select("query").distinct().select(
        F.xxhash64("query").alias("query_id"), F.col("query").alias("text")
    )
    found = retrieval.hybrid_search(docs, asked, k)
    texts = (
        join_small(docs, found, ["doc_id"])
        .withColumn("numbers", numbers(F.col("text")))
        .groupBy("query_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("position", "doc_id", "retrieval_score", "text", "numbers")
                )
            ).alias("context")
        )
    )
    return (
        records.withColumn("_q", F.xxhash64("query"))
        .join(texts.withColumnRenamed("query_id", "_q"), "_q", "left")
        .drop("_q")
        .withColumn("context", F.coalesce("context", F.expr("array()")))
    )


def grounded(records: DataFrame) -> DataFrame:
    """Adds ``explanation``, stated from the record and the first retrieved document."""
    lead = F.try_element_at("context", F.lit(1))["text"]
    explanation = grounded_explanation(
        F.col("tenant_id"),
        F.col("anomaly_type"),
        F.col("metric_date"),
        F.col("anomaly_score"),
        F.col("top_contributors"),
        lead,
    )
    return records.withColumn("explanation", explanation)


def checked(records: DataFrame) -> DataFrame:
    """Adds the faithfulness of ``explanation`` after one and, where needed, a wider pass.

    The wider pass reads one more document. A top-k list is a prefix of the top-(k+1) list,
    so both passes come from one search and the retry is a conditional column.
    """

    def score(documents):
        sources = F.concat(grounding.record_numbers(), grounding.context_numbers(documents))
        return grounding.faithfulness(F.col("explanation"), sources)

    first = F.slice("context", 1, F.greatest(F.size("context") - 1, F.lit(0)))
    return (
        records.withColumn("first_faithfulness", score(first))
        .withColumn("retried", ~grounding.is_faithful(F.col("first_faithfulness")))
        .withColumn(
            "faithfulness",
            F.when(F.col("retried"), score(F.col("context"))).otherwise(
                F.col("first_faithfulness")
            ),
        )
        .withColumn("context", F.when(F.col("retried"), F.col("context")).otherwise(first))
    )


def explained(records: DataFrame) -> DataFrame:
    """Explanation and check of records with their ``context``."""
    return checked(grounded(records))


def alerts(explained_records: DataFrame) -> DataFrame:
    """Alert rows with status, text and source ids."""
    status = grounding.alert_status(
        F.col("type_confidence"), grounding.is_faithful(F.col("faithfulness"))
    )
    return explained_records.select(
        "tenant_id",
        "metric_date",
        "anomaly_type",
        "anomaly_score",
        "type_confidence",
        "top_contributors",
        "metrics",
        "explanation",
        F.round("faithfulness", 3).alias("faithfulness"),
        F.transform("context", lambda d: d["doc_id"]).alias("sources"),
        status.alias("status"),
        "retried",
        alert_text(
            F.col("anomaly_type"),
            F.col("tenant_id"),
            F.col("metric_date"),
            F.col("anomaly_score"),
            F.col("explanation"),
        ).alias("text"),
    )


def explained_alerts(records: DataFrame, docs: DataFrame, base_k: int = 3) -> DataFrame:
    """The whole chain for every record. Runs the search jobs before returning."""
    held = cut_lineage(with_query(records))
    return alerts(explained(with_context(held, docs, base_k + 1)))
