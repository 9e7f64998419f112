"""Retrieval, grounding and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql
from checks.common import features_of, gold_of, rule_records_of
from tidemark.functions import scalars, text
from tidemark.operators import classify, grounding, inverted_index, retrieval, vector_search
from tidemark.plans import alerting, detection, explain
from tidemark.session import working_path
from tidemark.sources import sinks
from tidemark.sources.tables import spread, supplied


def _shown(column, places):
    """Scores compare at nine places; shown at fewer, rounded as decimals."""
    return F.round(column.cast("decimal(24,9)"), places).cast("double")


def _docs(spark, sf_dir):
    return spread(supplied(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", "text", (F.col("doc_id") % 60).alias("recency_minutes")
    )


def _asked(spark, sf_dir):
    return supplied(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def hash_embed(spark, sf_dir):
    rows = retrieval.hash_embed(_docs(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "bucket", F.round("weight", 9).alias("weight"))


def query_doc_pairs(spark, sf_dir):
    """BM25 of every pair that shares a term, summed per document so the check stays small."""
    index = inverted_index.build_index(_docs(spark, sf_dir))
    pairs = inverted_index.every_score(index, _asked(spark, sf_dir))
    return pairs.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.sum("score"), 4).alias("score"),
        _shown(F.max("score"), 6).alias("best"),
    )


def _sparse(spark, sf_dir, k):
    index = inverted_index.build_index(_docs(spark, sf_dir))
    return inverted_index.search(index, _asked(spark, sf_dir), k).leaders


def bm25_rank(spark, sf_dir):
    rows = _sparse(spark, sf_dir, 10)
    return rows.select("query_id", "doc_id", "rank", _shown(F.col("score"), 6).alias("score"))


def dense_rank(spark, sf_dir):
    """The vectors with an id divisible by 100 ask; all vectors answer."""
    vectors = supplied(spark, sf_dir, "embeddings")
    docs = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    queries = docs.where(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "query_id")
    rows = vector_search.nearest(docs, queries, 20)
    return rows.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def top_k_docs(spark, sf_dir):
    rows = _sparse(spark, sf_dir, 3)
    return rows.select("query_id", "doc_id", "rank")


def rrf_fuse(spark, sf_dir):
    """The leading 50 of the fusion of the dense and the BM25 ranking of all documents."""
    docs = _docs(spark, sf_dir).withColumn("recency_minutes", F.lit(None).cast("double"))
    ranks = retrieval.candidate_ranks(docs, _asked(spark, sf_dir), 50)
    both = ranks.select("query_id", "doc_id", F.explode(F.array("dense_rank", "sparse_rank")).alias("rank"))
    rows = retrieval.top_k_per_query(retrieval.rrf(both), 50)
    return rows.select("query_id", "doc_id", F.round("score", 9).alias("score"))


def freshness_boost(spark, sf_dir):
    """Document quality as score; unlabelled documents have no known age."""
    labels = supplied(spark, sf_dir, "labels")
    rows = _docs(spark, sf_dir).join(labels, "doc_id", "left")
    recency = F.when(F.col("quality").isNotNull(), F.col("recency_minutes"))
    score = retrieval.freshness(F.lit(0.5) + F.coalesce("quality", F.lit(0)), recency)
    return rows.select("doc_id", score.alias("score"))


def hybrid_search(spark, sf_dir):
    return retrieval.hybrid_search(_docs(spark, sf_dir), _asked(spark, sf_dir), 3)


def build_query(spark, sf_dir):
    return explain.with_query(rule_records_of(spark, sf_dir)).select(
        "tenant_id", "metric_date", "query"
    )


def _with_lead(spark, sf_dir):
    """Records with one document each as context, without a search: the longest text of the
    language that stands for their type."""
    longest = supplied(spark, sf_dir, "documents").groupBy("lang").agg(
        F.max_by("text", F.struct("n_chars", "doc_id")).alias("lead")
    ).withColumn("lead_numbers", F.array_distinct(scalars.numbers(F.col("lead"))))
    lang = (
        F.when(F.col("anomaly_type") == "payment_failure", "en")
        .when(F.col("anomaly_type") == "churn_spike", "fr")
        .when(F.col("anomaly_type") == "pricing_effect", "de")
        .otherwise("es")
    )
    records = rule_records_of(spark, sf_dir, 0.9).withColumn("lang", lang)
    return records.join(longest, "lang", "left")


def _explanation():
    return text.grounded_explanation(
        F.col("tenant_id"), F.col("anomaly_type"), F.col("metric_date"), F.col("anomaly_score"),
        F.col("top_contributors"), F.col("lead"),
    )


def grounded_template(spark, sf_dir):
    return _with_lead(spark, sf_dir).select(
        "tenant_id", "metric_date", _explanation().alias("explanation")
    )


def alert_text(spark, sf_dir):
    alert = text.alert_text(
        F.col("anomaly_type"), F.col("tenant_id"), F.col("metric_date"), F.col("anomaly_score"),
        _explanation(),
    )
    return _with_lead(spark, sf_dir).select("tenant_id", "metric_date", alert.alias("text"))


def reason_context(spark, sf_dir):
    prompt = text.reason_prompt(
        F.col("tenant_id"), F.col("metric_date"), F.col("anomaly_type"), F.col("type_confidence"),
        F.col("anomaly_score"), F.col("top_contributors"), F.col("metrics"),
        F.array("lead", "description"),
    )
    return _with_lead(spark, sf_dir).select("tenant_id", "metric_date", prompt.alias("prompt"))


def _checked(spark, sf_dir):
    """Explanations with one number changed where the type is payment_failure."""
    stated = F.when(
        F.col("anomaly_type") == "payment_failure",
        F.concat(_explanation(), F.lit(" Roughly 1,234,567 invoices and 98765 cards failed.")),
    ).otherwise(_explanation())
    sources = F.concat(grounding.record_numbers(), F.coalesce("lead_numbers", F.array()))
    return _with_lead(spark, sf_dir).withColumn(
        "faithfulness", grounding.faithfulness(stated, sources)
    )


def faithfulness(spark, sf_dir):
    return _checked(spark, sf_dir).select(
        "tenant_id", "metric_date", F.round("faithfulness", 9).alias("faithfulness")
    )


def alert_status(spark, sf_dir):
    rows = _checked(spark, sf_dir)
    return rows.select(
        "tenant_id", "metric_date",
        grounding.alert_status(
            F.col("type_confidence"), grounding.is_faithful(F.col("faithfulness"))
        ).alias("status"),
    )


def retry_wider(spark, sf_dir):
    """First pass and, where it is not grounded enough, the pass with one document more.

    Explanations of failed payments also quote the document that only the wider pass reads;
    those of price effects state figures that no document has.
    """
    records = explain.with_query(rule_records_of(spark, sf_dir))
    found = explain.grounded(explain.with_context(records, _docs(spark, sf_dir), 4))
    kind = F.col("anomaly_type")
    quoted = (
        F.when(kind == "payment_failure", F.try_element_at("context", F.lit(4))["text"])
        .when(kind == "pricing_effect", "Roughly 1,234,567 invoices, 98765 cards and 43219 plans.")
        .otherwise("")
    )
    rows = explain.checked(
        found.withColumn("explanation", F.concat_ws(" ", "explanation", quoted))
    )
    return rows.select(
        "tenant_id", "metric_date", F.size("context").alias("documents"), "retried",
        F.round("first_faithfulness", 9).alias("first_faithfulness"),
        F.round("faithfulness", 9).alias("faithfulness"),
    )


def rule_alerts(spark, sf_dir):
    """The alert chain on rule-typed records: every step has an SQL form."""
    rows = explain.explained_alerts(rule_records_of(spark, sf_dir), _docs(spark, sf_dir))
    return rows.select(
        "tenant_id", "metric_date", "anomaly_type", "faithfulness", "status", "explanation",
        F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"),
    )


#: (records, documents read) of each run of the alert job.
_RUNS = [(24, 1), (8, 3)]


def anomaly_log(spark, sf_dir):
    """The alert job run twice over stored gold: the second run reads more documents for fewer
    records and refreshes every column of those."""
    gold, log = working_path(spark, "gold"), working_path(spark, "anomaly-log")
    sinks.write_gold(gold_of(spark, sf_dir), gold)
    detect = lambda frame: detection.rule_records(detection.zscore_scores(frame))
    for run, (top_k, base_k) in enumerate(_RUNS):
        alerting.log_alerts(
            spark, gold, _docs(spark, sf_dir), log, run, detect, top_k, base_k, F.lit(f"run {run}")
        )
    listed = F.array_join(F.transform("sources", lambda s: s.cast("string")), ",")
    return alerting.read_log(spark, log).select(
        "tenant_id", "metric_date", "anomaly_type", "anomaly_score", "type_confidence",
        "explanation", "faithfulness", "status", listed.alias("sources"), "detected_at",
        *(F.element_at("metrics", m).alias(m) for m in sql.METRICS),
    )


def explained_alerts(spark, sf_dir):
    """The whole chain: ensemble, classifier, search, explanation, grounding, status."""
    frame = features_of(spark, sf_dir)
    classifier = classify.fit(detection.training_text(frame))
    records = detection.anomaly_records(
        detection.ensemble(frame), classifier, threshold=0.9
    )
    rows = explain.explained_alerts(records, _docs(spark, sf_dir))
    return rows.select(
        "tenant_id", "metric_date", "anomaly_type", "faithfulness", "status", "explanation",
        F.to_json("sources").alias("sources"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        hash_embed, query_doc_pairs, bm25_rank, dense_rank, top_k_docs, rrf_fuse, freshness_boost,
        hybrid_search, build_query, grounded_template, alert_text, reason_context, faithfulness,
        alert_status, retry_wider, rule_alerts, anomaly_log, explained_alerts,
    )
}

_ASKING = "asking AS (SELECT item_id AS query_id, text FROM benchmark),"

_LEAD = sql.RECORDS + """,
longest AS (
  SELECT lang, first(text ORDER BY n_chars DESC, doc_id DESC) AS lead FROM documents GROUP BY lang
),
near AS (
  SELECT r.*, lead,
    'Tenant ' || tenant_id || ' shows a ' || anomaly_type || ' anomaly on ' || metric_date
    || ' (score ' || anomaly_score || '). The main drivers were ' || drivers || '. '
    || string_split(trim(string_split(lead, chr(10))[1]), '.')[1] || '.' AS explanation
  FROM typed_records r LEFT JOIN longest ON lang = CASE anomaly_type
    WHEN 'payment_failure' THEN 'en' WHEN 'churn_spike' THEN 'fr'
    WHEN 'pricing_effect' THEN 'de' ELSE 'es' END
  WHERE anomaly_score >= 0.9
)"""

_QUERY_TEXT = "anomaly_type || ' ' || m1 || ' ' || m2 || ' ' || m3 || ' ' || description"


def _num(expr: str) -> str:
    return sql.NUMBERS.format(expr)


def _grounding(context: str, explanation: str = "explanation") -> str:
    """Faithfulness of `explanation` against the record and `context` text."""
    sources = f"""list_concat(
      [anomaly_score, type_confidence, mrr, conversion_rate, refund_rate, checkout_volume,
       s1, s2, s3],
      list_concat(list_concat({_num("tenant_id")}, {_num("metric_date")}),
                  list_concat({_num("description")}, {_num(context)})))"""
    stated = _num(explanation)
    return f"""CASE WHEN len({stated}) = 0 THEN 1.0 ELSE
      len(list_filter({stated}, lambda n: len(list_filter({sources}, lambda s:
        abs(n - s) < 1e-6 OR (s <> 0 AND abs(n - s) / abs(s) < 1e-3))) > 0))
      / CAST(len({stated}) AS DOUBLE) END"""


_CHECKED = _LEAD + f""",
checked AS (
  SELECT *, explanation || CASE WHEN anomaly_type = 'payment_failure'
    THEN ' Roughly 1,234,567 invoices and 98765 cards failed.' ELSE '' END AS stated FROM near
),
graded AS (SELECT *, {_grounding("lead", "stated")} AS faithfulness FROM checked)"""

_STATUS = """CASE WHEN type_confidence < 0.6 THEN 'held_for_review'
  WHEN faithfulness < 0.85 THEN 'held_low_faithfulness' ELSE 'ready' END"""

_QUERIED = sql.RECORDS + f""",
queried AS (SELECT *, {_QUERY_TEXT} AS query FROM flagged),
asking AS (SELECT row_number() OVER (ORDER BY query) AS query_id, query AS text
  FROM (SELECT DISTINCT query FROM queried)),""" + sql.HYBRID


def _explained(base_k: int, quoted: str = "''") -> str:
    """CTEs up to final_<k>: explanations checked against k documents, then against one more."""
    return f""",
contexts_{base_k} AS (
  SELECT a.text AS query,
    first(d.text ORDER BY f.position) AS lead,
    first(d.text ORDER BY f.position) FILTER (f.position = {base_k}) AS last_text,
    string_agg(d.text, ' | ' ORDER BY f.position) FILTER (f.position < {base_k}) AS narrow,
    string_agg(d.text, ' | ' ORDER BY f.position) AS wide,
    string_agg(CAST(d.doc_id AS VARCHAR), ',' ORDER BY f.position) FILTER (f.position < {base_k})
      AS narrow_ids,
    string_agg(CAST(d.doc_id AS VARCHAR), ',' ORDER BY f.position) AS wide_ids
  FROM found f JOIN documents d USING (doc_id) JOIN asking a USING (query_id)
  WHERE f.position <= {base_k} GROUP BY a.text
),
stated_{base_k} AS (
  SELECT q.*, c.* EXCLUDE (query),
    'Tenant ' || tenant_id || ' shows a ' || anomaly_type || ' anomaly on ' || metric_date
    || ' (score ' || anomaly_score || '). The main drivers were ' || drivers || '. '
    || string_split(trim(string_split(lead, chr(10))[1]), '.')[1] || '.'
    || {quoted} AS explanation
  FROM queried q JOIN contexts_{base_k} c ON c.query = q.query
),
passes_{base_k} AS (
  SELECT *, {_grounding("narrow")} AS first_faithfulness, {_grounding("wide")} AS wider
  FROM stated_{base_k}
),
final_{base_k} AS (
  SELECT *, first_faithfulness < 0.85 AS retried,
    CASE WHEN first_faithfulness < 0.85 THEN wider ELSE first_faithfulness END AS faithfulness
  FROM passes_{base_k}
)"""


_QUOTED = """CASE anomaly_type WHEN 'payment_failure' THEN ' ' || last_text
  WHEN 'pricing_effect' THEN ' Roughly 1,234,567 invoices, 98765 cards and 43219 plans.'
  ELSE '' END"""


def _logged(run: int) -> str:
    """Rows of one run of the alert job."""
    top_k, base_k = _RUNS[run]
    return f"""SELECT tenant_id, metric_date, anomaly_type, anomaly_score, type_confidence, explanation,
        round(faithfulness, 3) AS faithfulness, {_STATUS} AS status,
        CASE WHEN retried THEN wide_ids ELSE narrow_ids END AS sources, 'run {run}' AS detected_at,
        {", ".join(sql.METRICS)}
      FROM (SELECT *, row_number() OVER (ORDER BY anomaly_score DESC, tenant_id, metric_date) AS place
        FROM final_{base_k}) WHERE place <= {top_k}"""


ORACLE = {
    "hash_embed": f"""WITH t AS (
        SELECT doc_id, unnest({sql.TOKENS.format("text")}) AS token FROM documents),
      c AS (SELECT doc_id, CAST('0x' || substr(md5(token), 1, 2) AS INTEGER) AS bucket,
        count(*) AS n FROM t GROUP BY 1, 2)
      SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS weight
      FROM c""",
    "query_doc_pairs": f"""WITH {_ASKING} {sql.BM25}
      SELECT doc_id, count(*) AS queries, round(sum(score), 4) AS score,
        CAST(round(CAST(max(score) AS DECIMAL(24, 9)), 6) AS DOUBLE) AS best FROM bm25 GROUP BY doc_id""",
    "bm25_rank": f"""WITH {_ASKING} {sql.BM25}
      SELECT query_id, doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS rank,
        CAST(round(CAST(score AS DECIMAL(24, 9)), 6) AS DOUBLE) AS score FROM bm25
      WINDOW w AS (PARTITION BY query_id ORDER BY bm25.score DESC, doc_id DESC)
      QUALIFY row_number() OVER w <= 10""",
    "dense_rank": """WITH q AS (
        SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
      s AS (SELECT query_id, vec_id AS doc_id,
        round(list_cosine_similarity(qv, embedding::DOUBLE[]), 9) AS full_score
        FROM q, embeddings)
      SELECT query_id, doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS rank,
        round(full_score, 6) AS score FROM s
      WINDOW w AS (PARTITION BY query_id ORDER BY full_score DESC, doc_id DESC)
      QUALIFY row_number() OVER w <= 20""",
    "top_k_docs": f"""WITH {_ASKING} {sql.BM25}
      SELECT query_id, doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS rank FROM bm25
      WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id DESC)
      QUALIFY row_number() OVER w <= 3""",
    "rrf_fuse": f"""WITH {_ASKING} {sql.HYBRID},
      both_ranks AS (
        SELECT query_id, doc_id, 1.0::DOUBLE / (60 + dr) + 1.0::DOUBLE / (60 + sr) AS fused_score FROM ranks
      )
      SELECT query_id, doc_id, round(fused_score, 9) AS score FROM both_ranks
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, doc_id DESC) <= 50""",
    "freshness_boost": """
      SELECT d.doc_id, (0.5::DOUBLE + coalesce(quality, 0)) * CASE WHEN quality IS NOT NULL
        AND d.doc_id % 60 <= 15 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS score
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "hybrid_search": f"""WITH {_ASKING} {sql.HYBRID}
      SELECT query_id, doc_id, retrieval_score, CAST(position AS INTEGER) AS position
      FROM found WHERE position < 3""",
    "build_query": f"""WITH {sql.RECORDS}
      SELECT tenant_id, metric_date, {_QUERY_TEXT} AS query FROM flagged""",
    "grounded_template": f"WITH {_LEAD} SELECT tenant_id, metric_date, explanation FROM near",
    "alert_text": f"""WITH {_LEAD}
      SELECT tenant_id, metric_date,
        CASE anomaly_type WHEN 'payment_failure' THEN '💳' WHEN 'churn_spike' THEN '📉'
          WHEN 'infrastructure_issue' THEN '🚨' ELSE '⚠️' END
        || ' *' || anomaly_type || '* for `' || tenant_id || '` on ' || metric_date
        || ' (score ' || anomaly_score || ')' || chr(10) || explanation AS text
      FROM near""",
    "reason_context": f"""WITH {_LEAD}
      SELECT tenant_id, metric_date,
        'TENANT: ' || tenant_id || chr(10) || 'DATE: ' || metric_date || chr(10)
        || 'ANOMALY TYPE: ' || anomaly_type || ' (confidence ' || type_confidence || ')' || chr(10)
        || 'SCORE: ' || anomaly_score || chr(10) || 'DRIVERS: ' || drivers || chr(10)
        || 'METRICS: {{''mrr'': ' || mrr || ', ''conversion_rate'': ' || conversion_rate
        || ', ''refund_rate'': ' || refund_rate || ', ''checkout_volume'': ' || checkout_volume
        || '}}' || chr(10) || chr(10) || 'RETRIEVED CONTEXT:' || chr(10) || '- ' || lead || chr(10)
        || '- ' || description || chr(10) || chr(10) || '{text.PROMPT_INSTRUCTION}' AS prompt
      FROM near""",
    "faithfulness": f"""WITH {_CHECKED}
      SELECT tenant_id, metric_date, round(faithfulness, 9) AS faithfulness FROM graded""",
    "alert_status": f"""WITH {_CHECKED}
      SELECT tenant_id, metric_date, {_STATUS} AS status FROM graded""",
    "retry_wider": f"""WITH {_QUERIED}{_explained(3, _QUOTED)}
      SELECT tenant_id, metric_date, CASE WHEN retried THEN 4 ELSE 3 END AS documents, retried,
        round(first_faithfulness, 9) AS first_faithfulness,
        round(faithfulness, 9) AS faithfulness FROM final_3""",
    "rule_alerts": f"""WITH {_QUERIED}{_explained(3)}
      SELECT tenant_id, metric_date, anomaly_type, round(faithfulness, 3) AS faithfulness,
        {_STATUS} AS status, explanation,
        CASE WHEN retried THEN wide_ids ELSE narrow_ids END AS sources
      FROM final_3""",
    "anomaly_log": f"""WITH {_QUERIED}{_explained(1)}{_explained(3)},
      first_run AS ({_logged(0)}),
      second_run AS ({_logged(1)})
      SELECT * FROM second_run UNION ALL
      SELECT f.* FROM first_run f ANTI JOIN second_run USING (tenant_id, metric_date, anomaly_type)""",
}
