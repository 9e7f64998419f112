"""Token counts as an exact length histogram.

Documents are encoded once and aggregated by encoded length; with suffix sums next to every
length, totals, quantiles and totals after truncation follow for every context limit without
another pass: of documents cut at L tokens, those of at least L give L each and the shorter ones
their length.

Counts are summed per task before they are shuffled, so a length or group with a third of all
rows does not matter. Suffix sums run inside stretches of ``STRETCH`` lengths and over the totals
of the stretches, whose number is bounded by the longest document.

Defined results: a null or empty text has length 0; repeated rows count each; a null in a group
column is a group; a group column named like a result is refused; an empty table gives an empty
histogram.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import bounded_batches, slices, texts_of, written

STRETCH = 1024
_ENCODINGS: dict[str, object] = {}


def byte_encoding(path: str):
    """The byte-level encoding of a rank file, held per worker; special strings in a text are
    ordinary text."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODINGS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoded_lengths(docs: DataFrame, by: list[str], path: str | None = None) -> DataFrame:
    """One row per document: the group columns and ``n_tokens``."""
    bounded_batches(docs.sparkSession)
    path = path or default_path()
    if {"n_tokens", "text"} & {c.lower() for c in by}:
        raise ValueError("group columns can't be called n_tokens or text")
    rows = docs.select(*by, "text")

    def run(batches):
        encode = byte_encoding(path).encode_ordinary
        for whole in batches:
            for batch in slices(whole, "text"):
                lengths = [len(encode(t)) if t else 0 for t in texts_of(batch, "text")]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in by), pa.array(lengths, pa.int64())],
                    names=[*by, "n_tokens"],
                )

    return rows.mapInArrow(run, rows.drop("text").schema.add("n_tokens", "long"))


def length_histogram(docs: DataFrame, by: list[str] = (), path: str | None = None) -> DataFrame:
    """Per group and length: documents, and how many documents and tokens have at least it, all
    tokens after truncation to it, and the share of documents up to it."""
    by = list(by)
    counts = encoded_lengths(docs, by, path).groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs"))
    # the counts are few and used twice; texts are encoded once
    return suffix_sums(written(counts, "token-counts"), by)


def suffix_sums(counts: DataFrame, by: list[str]) -> DataFrame:
    counts = counts.withColumn("_stretch", F.floor(F.col("n_tokens") / STRETCH)).withColumn(
        "_tokens", F.col("n_docs") * F.col("n_tokens")
    )
    later = Window.partitionBy(*by).orderBy(F.desc("_stretch"))
    before = later.rowsBetween(Window.unboundedPreceding, -1)
    stretches = counts.groupBy(*by, "_stretch").agg(
        F.sum("n_docs").alias("_docs"), F.sum("_tokens").alias("_all")
    )
    whole = Window.partitionBy(*by)
    stretches = stretches.select(
        *(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)),
        F.col("_stretch").alias("_at"),
        F.coalesce(F.sum("_docs").over(before), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_tokens_after"),
        *(F.sum(c).over(whole).alias(c) for c in ("_docs", "_all")),
    )
    same = F.col("_stretch") == F.col("_at")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    inside = Window.partitionBy(*by, "_stretch").orderBy(F.desc("n_tokens"))
    docs = F.sum("n_docs").over(inside) + F.col("_docs_after")
    tokens = F.sum("_tokens").over(inside) + F.col("_tokens_after")
    return (
        counts.join(stretches, same)
        .withColumn("docs_at_least", docs)
        .withColumn("tokens_at_least", tokens)
        .select(
            *by,
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (F.col("_all") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias(
                "truncated_tokens"
            ),
            ((F.col("_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_docs")).alias(
                "share_up_to"
            ),
        )
    )


def truncated_totals(histogram: DataFrame, limits: list[int], by: list[str] = ()) -> DataFrame:
    """Tokens left when every document is cut at each limit."""
    by = list(by)
    at = histogram.withColumn("limit", F.explode(F.array(*(F.lit(x).cast("long") for x in limits))))
    return at.groupBy(*by, "limit").agg(
        F.sum(F.col("n_docs") * F.least("n_tokens", "limit")).alias("tokens"),
        F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("cut_docs"),
    )


def quantiles(histogram: DataFrame, shares: list[float], by: list[str] = ()) -> DataFrame:
    """The smallest length up to which at least each share of the documents goes."""
    by = list(by)
    at = histogram.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return at.where(F.col("share_up_to") >= F.col("share")).groupBy(*by, "share").agg(
        F.min("n_tokens").alias("n_tokens")
    )
