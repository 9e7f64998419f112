"""One registered query per operator, over whole tables, and the SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import centroids, spf_packing
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.jaccard_join import jaccard_groups
from tidemark.llm.kneser_ney import score, train
from tidemark.llm.packing import digests, packed, tokenized
from tidemark.llm.periodic_runs import periodic_runs
from tidemark.llm.pii import KINDS, count_kind, personal_data, span_text
from tidemark.llm.pu_quality import pu_quality
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.token_counts import length_histogram
from tidemark.llm.toxicity import toxicity
from tidemark.llm.warc import archive_folder, read_records, write_archives
from tidemark.session import ensure_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def id_remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(_documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    return quality_rules(docs, labels, keep_text=False)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(digests(tokenized(_documents(spark, sf_dir))))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, payloads=False).drop("url")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learned only from rows that are not held out; the unlabelled sample too comes
    from those."""
    docs, labels = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    trusted = labels.where((id_remainder(3) != 1) & (F.col("quality") == 1))
    scored = pu_quality(docs, trusted, docs.where(id_remainder(3) != 1), keep_text=False)
    return scored.select(
        "doc_id", F.coalesce(id_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    return toxicity(docs, labels, keep_text=False)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(id_remainder(10) == 0, F.lit(False))
    scored = score(docs, train(docs.where(~held_out)), keep_text=False)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(_documents(spark, sf_dir), keep_text=False)
    return found.select(
        "doc_id",
        *(count_kind("base_spans", kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(span_text("base_spans"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_documents(spark, sf_dir))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    listed = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.withColumn("centroid_sha256", F.sha2(listed, 256)).drop("centroid")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """Of every tenth document, by a hash of its id, the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("_g", F.floor(h / 10)).withColumn(
        "_words", F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    )
    n = F.size("_words")
    at = chosen.withColumn("_n", n).withColumn("_a", F.when(n > 0, F.col("_g") % F.greatest(n, F.lit(1))))
    tail = F.col("_n") - F.col("_a")
    at = at.withColumn("_p", (1 + F.floor(tail / (3 + F.col("_g") % 8))).cast("int"))
    period = F.slice("_words", (F.col("_a") + 1).cast("int"), F.col("_p"))
    times = F.ceil(tail / F.col("_p")).cast("int")
    words = F.concat(
        F.slice("_words", F.lit(1), F.col("_a").cast("int")),
        F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), tail.cast("int")),
    )
    text = F.when(F.col("_a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text"))
    return at.select(*(text.alias(c) if c == "text" else c for c in docs.columns))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeated_tails(_documents(spark, sf_dir)), keep_text=False)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    longest = F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))
    best = found.withColumn("_best", F.array_min(longest))
    length, period = -F.col("_best.col1"), F.col("_best.period")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_spf_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = spf_packing.pack(_documents(spark, sf_dir))
    return placed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_token_counts,
        op2_quality_rules,
        op3_best_fit_packing,
        op4_warc,
        op5_quality_classifier,
        op6_toxicity,
        op7_lm_scoring,
        op8_pii,
        op9_decontamination,
        op10_jaccard_join,
        op11_centroid_clustering,
        op12_periodic_runs,
        op13_spf_packing,
    )
}

#: Base32 has no function in SQL: four groups of ten hexadecimal digits, eight characters each.
_BASE32 = """array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(hex, 1 + 10 * (k // 8), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31)::INT, 1)
    FOR k IN range(32)], '')"""

_OP4 = f"""
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), ranked AS (
    SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM payloads
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM ranked
"""

_WORDS = """regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{80}-\\x{10FFFF}]+')"""

_OP9 = f"""
WITH items AS (
    SELECT item_id, ws, least(len(ws), 10) AS size FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark)
    WHERE len(ws) > 0
), windows AS (
    SELECT item_id, size, array_to_string(ws[p:p + size - 1], ' ') AS gram
    FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS p FROM items)
), docs AS (
    SELECT doc_id, {_WORDS} AS ws FROM documents
), hits AS (
    SELECT DISTINCT d.doc_id, d.p, w.size, w.item_id
    FROM (
        SELECT doc_id, size, p, array_to_string(ws[p:p + size - 1], ' ') AS gram
        FROM (
            SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS p
            FROM docs, (SELECT DISTINCT size FROM items)
        )
    ) d JOIN windows w ON d.size = w.size AND d.gram = w.gram
), covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM (SELECT DISTINCT doc_id, p, size FROM hits))
    GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""



def _nearest(values: str, found: str) -> str:
    """Squared distance times 40 plus the number of the nearest centroid, per vector."""
    distance = "list_dot_product(v, v) - 2 * list_dot_product(v, w) + list_dot_product(w, w)"
    return f"""{found} AS MATERIALIZED (
    SELECT row_id, any_value(vec_id) AS vec_id, any_value(v) AS v, min(40 * ({distance})::BIGINT + c) AS best
    FROM vectors, {values} GROUP BY row_id
)"""


def _round(r: int) -> str:
    return f"""{_nearest(f"centroids{r}", f"found{r}")}, sums{r} AS (
    SELECT best % 40 AS c, i, sum(x)::BIGINT AS s, count(*) AS n
    FROM (SELECT best, unnest(v) AS x, unnest(range(64)) AS i FROM found{r}) GROUP BY ALL
), centroids{r + 1} AS MATERIALIZED (
    SELECT c, coalesce(moved, w) AS w FROM centroids{r} LEFT JOIN (
        SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS moved FROM sums{r} GROUP BY c
    ) USING (c)
)"""


_OP11 = f"""
WITH vectors AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), centroids0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS w
    FROM vectors WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id), v LIMIT 40
), {", ".join(map(_round, range(5)))}, {_nearest("centroids5", "last")}
SELECT vec_id, (best % 40)::INTEGER AS cluster, best // 40 AS distance,
    sum(best // 40) OVER (PARTITION BY best % 40)::BIGINT AS cluster_inertia,
    sum(best // 40) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(list_transform(w, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM last JOIN centroids5 ON c = best % 40
"""

ORACLE: dict[str, str] = {
    "op4_warc": _OP4,
    "op9_decontamination": _OP9,
    "op11_centroid_clustering": _OP11,
}
