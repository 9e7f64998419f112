from __future__ import annotations

import math
import re
from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars, text
from tidemark.operators import grounding, retrieval
from tidemark.plans import alerting, explain

CORPUS = [
    (0, "Invoices bounce when banks renew their cards; ask the ledger team for the retry plan.", 900),
    (1, "Seat counts fell after the spring contract reviews. Compare the renewal ledger.", 5200),
    (2, "Gateway latency above two seconds empties the basket page before anyone pays.", 7000),
    (3, "A ledger month closes on the last working day.", 90000),
    (4, "Gateway incident: the basket page timed out and sales fell by 62% until the rollback.", 5),
    (5, "The yearly plan got cheaper, so fewer seats renew monthly.", 14),
    (6, "", None),
]
QUERIES = [
    (1, "basket page timed out sales fell 62% gateway rollback"),
    (2, "ledger renewal seats Seats fell to 41.5%"),
    (3, "zebra"),
    (4, "seats seats seats plan"),
]


def words(s: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", s.lower())


def brute_force(docs, queries, k):
    """Every document ranked for every query, one at a time."""
    lists = {d: words(t) for d, t, _ in docs}
    n = len(docs)
    mean = sum(map(len, lists.values())) / n
    df = Counter(t for ws in lists.values() for t in set(ws))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    average = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * average if v < 0 else v for t, v in idf.items()}

    def vector(ws):
        v = np.zeros(256)
        for w in ws:
            v[md5(w.encode()).digest()[0]] += 1
        return v

    out = []
    for q, t in queries:
        asked, qv = words(t), vector(words(t))
        dense, sparse = {}, {}
        for d, ws in lists.items():
            dv = vector(ws)
            norm = np.linalg.norm(qv) * np.linalg.norm(dv)
            dense[d] = round(float(qv @ dv) / norm, 9) if norm else 0.0
            tf = Counter(ws)
            sparse[d] = round(
                sum(
                    idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean))
                    for w in asked
                ),
                9,
            )
        score = Counter()
        for ranking in (dense, sparse):
            for rank, d in enumerate(sorted(ranking, key=lambda d: (-ranking[d], -d))):
                score[d] += 1 / (60 + rank)
        for d, _, recency in docs:
            if recency is not None and recency <= 15:
                score[d] *= 3
        best = sorted(score, key=lambda d: (-score[d], -d))[:k]
        out += [(q, d, round(score[d], 5), i) for i, d in enumerate(best)]
    return sorted(out)


def search(spark, docs, queries, k):
    d = spark.createDataFrame(docs, "doc_id long, text string, recency_minutes int")
    q = spark.createDataFrame(queries, "query_id long, text string")
    found = retrieval.hybrid_search(d.repartition(3), q, k)
    return sorted((r[0], r[1], r[2], r[3]) for r in found.collect())


def same(got, expected):
    assert [(g[0], g[1], g[3]) for g in got] == [(e[0], e[1], e[3]) for e in expected]
    assert np.allclose([g[2] for g in got], [e[2] for e in expected], atol=1.1e-5)


@pytest.mark.parametrize("k", [1, 3, 7])
def test_small_corpus_equals_brute_force(spark, k):
    same(search(spark, CORPUS, QUERIES, k), brute_force(CORPUS, QUERIES, k))


def test_recent_event_is_found(spark):
    assert 4 in [r[1] for r in search(spark, CORPUS, QUERIES[:1], 3)]


def large_corpus(n=3000, seed=4):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = []
    for d in range(n):
        if d % 3 == 0:  # a third of all documents are copies of one text
            body = "w1 w2 w3 w3"
        else:
            body = " ".join(rng.choice(vocabulary, size=int(rng.integers(1, 25))))
        docs.append((d, body, int(rng.integers(0, 60))))
    return docs


def test_corpus_deeper_than_the_candidates_equals_brute_force(spark):
    docs = large_corpus()
    assert len(docs) > 2 * retrieval.candidate_depth(3)
    queries = [(i, f"w{i} w{2 * i} w{i} w{59 - i}") for i in range(6)] + [(9, "absent words")]
    same(search(spark, docs, queries, 3), brute_force(docs, queries, 3))


def test_queries_in_several_batches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BATCH", 4)
    monkeypatch.setattr(retrieval, "_BLOCK_CELLS", 3000)
    docs = large_corpus(400)
    queries = [(i, f"w{i} w{2 * i}") for i in range(11)]
    same(search(spark, docs, queries, 2), brute_force(docs, queries, 2))


def test_only_documents_that_can_lead_are_ranked(spark):
    d = spark.createDataFrame(large_corpus(), "doc_id long, text string, recency_minutes int")
    q = spark.createDataFrame([(i, f"w{i} w{2 * i} w{59 - i}") for i in range(6)], "query_id long, text string")
    ranked = retrieval.candidate_ranks(d.repartition(3), q, 3)
    sizes = [r["count"] for r in ranked.groupBy("query_id").count().collect()]
    assert len(sizes) == 6 and max(sizes) < retrieval.candidate_depth(3) / 2


def test_words_of_bytes_are_the_tokens(spark):
    texts = ["", None, "abc", "Ab1 2c", "é1é x\u212a ", "a-b_c\nd", "\u0130stanbul", "end"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    lowered = [r[0] for r in rows.select(F.lower("text")).collect()]
    expected = [r[0] or [] for r in rows.select(scalars.tokens(F.col("text"))).collect()]
    whole = pa.array(["x1", *lowered, "y"], pa.string())
    assert retrieval.words_of(whole.slice(1, len(texts))).to_pylist() == expected
    assert retrieval.words_of(pa.array([], pa.string())).to_pylist() == []


def test_candidate_depth_bound():
    for k in (1, 3, 4, 10):
        depth = retrieval.candidate_depth(k)
        assert 3.0 * 2 / (60 + depth) <= 1 / (60 + k - 1) < 3.0 * 2 / (60 + depth - 1)


RECORD = {
    "tenant_id": "quill_77",
    "metric_date": "2026-02-27",
    "anomaly_type": "payment_failure",
    "anomaly_score": 0.913,
    "type_confidence": 0.71,
    "top_contributors": [("refund_rate", 0.27), ("mrr", -4.3)],
    "description": "Refunds rose on the gateway page.",
    "metrics": {
        "mrr": 31450.0, "refund_rate": 0.27, "conversion_rate": 0.88, "checkout_volume": 7200.0
    },
}
RECORD_SCHEMA = (
    "tenant_id string, metric_date string, anomaly_type string, anomaly_score double, "
    "type_confidence double, top_contributors array<struct<metric:string,sd:double>>, "
    "description string, metrics map<string,double>"
)


def record(spark, **changes):
    return spark.createDataFrame([{**RECORD, **changes}], RECORD_SCHEMA)


@pytest.mark.parametrize(
    ("explanation", "low", "high"),
    [
        ("No figures here.", 1.0, 1.0),
        ("Rate 0.27, volume 7,200 and conversion 0.88.", 1.0, 1.0),
        ("It fell by 0.53 and 461.", 0.0, 0.0),
        ("Moved −4.30sd to $31,450.", 1.0, 1.0),
        ("Tenant quill_77 on 2026-02-27 and 12345.", 0.8, 0.8),
    ],
)
def test_faithfulness(spark, explanation, low, high):
    score = grounding.faithfulness(F.lit(explanation), grounding.record_numbers())
    value = record(spark).select(score.alias("s")).first()["s"]
    assert low <= value <= high


def docs_frame(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string, recency_minutes int")


@pytest.mark.parametrize(("confidence", "status"), [(0.71, "ready"), (0.4, "held_for_review")])
def test_alert_chain(spark, confidence, status):
    alert = explain.explained_alerts(
        record(spark, type_confidence=confidence), docs_frame(spark)
    ).first()
    assert alert["status"] == status and alert["faithfulness"] == 1.0 and not alert["retried"]
    assert len(alert["sources"]) == 3
    assert alert["text"].startswith("💳 *payment_failure* for `quill_77` on 2026-02-27 (score 0.913)")
    assert "refund_rate (+0.27sd), mrr (-4.30sd)" in alert["explanation"]


FIGURES = "We count 61234 and 71234 and 81234 and 91234 of them."


@pytest.mark.parametrize(
    ("written_in", "retried", "documents", "score"),
    [(0, False, 3, 1.0), (3, True, 4, 1.0), (None, True, 4, 0.0)],
)
def test_ungrounded_text_is_retried_with_one_document_more(
    spark, written_in, retried, documents, score
):
    """The figures stand in the first document, only in the one more, or nowhere."""
    found = explain.with_context(explain.with_query(record(spark)), docs_frame(spark), 4)
    context = F.transform(
        "context",
        lambda d, i: d.withField(
            "numbers",
            F.when(i == (-1 if written_in is None else written_in), scalars.numbers(F.lit(FIGURES)))
            .otherwise(d["numbers"]),
        ),
    )
    stated = found.withColumn("context", context).withColumn("explanation", F.lit(FIGURES))
    checked = explain.checked(stated).first()
    assert (checked["retried"], len(checked["context"])) == (retried, documents)
    assert checked["faithfulness"] == score


def test_alert_job_writes_the_leading_records_and_refreshes_them(spark, tmp_path):
    days = [
        ("quill_77", f"2026-02-{day:02d}", 100.0 + day, 0.5, 0.1, 40.0) for day in range(1, 8)
    ]
    gold = spark.createDataFrame(
        days, "tenant_id string, metric_date string, mrr double, conversion_rate double, "
        "refund_rate double, checkout_volume double",
    )
    gold.write.parquet(str(tmp_path / "gold"))

    def detect(frame):
        own = record(spark).drop("tenant_id", "metric_date", "anomaly_score")
        scored = frame.select("tenant_id", "metric_date", (F.col("mrr") / 200).alias("anomaly_score"))
        return scored.crossJoin(own)  # one row

    log = str(tmp_path / "alerts")
    run = lambda n, k, found: alerting.log_alerts(
        spark, str(tmp_path / "gold"), docs_frame(spark), log, n, found, k, 2,
        detected_at=F.lit(f"run {n}"),
    )
    run(0, 3, detect)
    run(1, 1, detect)
    run(2, 5, lambda frame: detect(frame).where("false"))  # nothing found: nothing written
    got = {r["metric_date"]: r for r in alerting.read_log(spark, log).collect()}
    assert {day: r["detected_at"] for day, r in got.items()} == {
        "2026-02-07": "run 1", "2026-02-06": "run 0", "2026-02-05": "run 0",
    }
    assert all(len(r["sources"]) == 2 and r["status"] == "ready" for r in got.values())


def test_status_order(spark):
    got = spark.createDataFrame(
        [(0.4, False), (0.7, False), (0.7, None), (0.6, True)], "c double, f boolean"
    ).select(grounding.alert_status(F.col("c"), F.col("f")).alias("s"))
    assert [r["s"] for r in got.collect()] == [
        "held_for_review", "held_low_faithfulness", "held_low_faithfulness", "ready",
    ]


def test_fixed_point_text_equals_python(spark):
    rng = np.random.default_rng(7)
    values = np.r_[
        rng.uniform(0, 1000, 3000),
        np.round(rng.uniform(0, 300, 3000), 2),
        np.arange(0, 200) / 8,
        np.arange(0, 400) / 20,
    ]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = df.select(
        "v", *[scalars.fixed(F.col("v"), p).alias(f"p{p}") for p in (0, 1, 2)]
    ).collect()
    for r in got:
        assert (r["p0"], r["p1"], r["p2"]) == (f"{r['v']:.0f}", f"{r['v']:.1f}", f"{r['v']:.2f}")


def test_plain_text_equals_python(spark):
    values = [0.0, 0.0008, 0.001, 0.00012, 1.0, 41200.0, 12345678.9, 1e9, 123456789012.25, 0.5, -0.0008]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", scalars.plain_text(F.col("v")).alias("t")).collect():
        assert r["t"] == repr(r["v"])


@pytest.mark.parametrize(
    ("metric", "value", "shown"),
    [("mrr", 41200.0, "$41.2k"), ("mrr", 999.0, "$999"), ("refund_rate", 0.16, "16.0%"),
     ("checkout_volume", 880.0, "880"), ("checkout_volume", 1880.0, "1.9k")],
)
def test_metric_display(spark, metric, value, shown):
    assert spark.range(1).select(text.metric_text(F.lit(metric), F.lit(value))).first()[0] == shown


@pytest.mark.parametrize(
    ("raw", "label"),
    [(" Churn Spike ", "churn_spike"), ("a dip", "seasonal_dip"), ("nothing", "payment_failure"),
     ("infrastructure payment", "payment_failure"), ("issue of infrastructure", "infrastructure_issue")],
)
def test_nearest_label(spark, raw, label):
    assert spark.range(1).select(scalars.nearest_label(F.lit(raw))).first()[0] == label
