"""Exact vector search against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import vector_search


def by_hand(docs, queries, k):
    found = []
    for q, a in queries:
        own = []
        for d, b in docs:
            size = np.linalg.norm(a) * np.linalg.norm(b)
            own.append((-round(float(np.dot(a, b) / size), 9) if size else 0.0, -d))
        found += [(q, rank, -d, -s) for rank, (s, d) in enumerate(sorted(own)[:k])]
    return sorted(found)


def vectors(n=1500, width=8, seed=0):
    """Clusters, a third of one vector, zero vectors, opposite vectors."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, width))
    rows = [list(map(float, middles[k % 20] + 0.1 * rng.normal(size=width))) for k in range(n)]
    for k in range(0, n, 3):
        rows[k] = rows[0]
    rows[4], rows[5], rows[7] = [0.0] * width, [0.0] * width, [-x for x in rows[0]]
    return list(enumerate(rows))


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, vector array<double>")


@pytest.mark.parametrize("k", [1, 7, 600])
def test_nearest_equals_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vector_search, "QUERY_CHUNK", 4)
    docs = vectors()
    queries = [(q, v) for q, v in docs if q % 100 == 0 or q in (4, 7)]
    d, q = frame(spark, docs, "doc_id").repartition(5), frame(spark, queries, "query_id")
    got = sorted(
        (r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in vector_search.nearest(d, q, k).collect()
    )
    expected = by_hand(docs, queries, k)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert np.allclose([g[3] for g in got], [e[3] for e in expected], atol=2e-9)
    same = sum(g[2] == e[2] for g, e in zip(got, expected, strict=True))
    assert same > 0.999 * len(got)  # the last digit decides between near equal scores


def test_cells_are_skipped_and_jobs_do_not_grow_with_the_queries(spark):
    docs = [row for row in vectors(3000) if row[0] % 3]
    d = frame(spark, docs, "doc_id").repartition(4)
    index = vector_search.build_index(d)
    jobs = []
    for step in (300, 30):
        queries = [(q, v) for q, v in docs if q % step == 1 and any(v)]
        group = f"search-{step}"
        spark.sparkContext.setJobGroup(group, "")
        found = vector_search.search(index, frame(spark, queries, "query_id"), 5)
        read = found.read.select(F.count(F.lit(1))).first()[0]
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        assert read < 0.25 * len(queries) * len(index.cells.number)
    assert abs(jobs[0] - jobs[1]) <= 1


def test_null_and_missing_vectors(spark):
    docs = [(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])]
    d, q = frame(spark, docs, "doc_id"), frame(spark, [(9, [2.0, 0.0]), (8, None), (9, [2.0, 0.0])], "query_id")
    rows = vector_search.nearest(d, q, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in rows] == [(9, 1, 1.0), (9, 3, 0.0)]
    assert vector_search.nearest(d.where("false"), q, 3).count() == 0
    assert vector_search.nearest(d, q.where("false"), 3).count() == 0
    zeros = frame(spark, [(k, [0.0, 0.0]) for k in range(5)], "doc_id")
    assert [r["doc_id"] for r in vector_search.nearest(zeros, q, 2).orderBy("rank").collect()] == [4, 3]
