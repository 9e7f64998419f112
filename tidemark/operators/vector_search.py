"""Exact nearest vectors by cosine, with cells that the triangle inequality skips.

Pivots are some of the vectors. Every vector belongs to the ring of its angle around its nearest
pivot; a pivot's ring is a cell. Angles are a metric, so a vector in a ring between ``low`` and
``high`` is at least ``max(angle - high, low - angle)`` away from a query at ``angle`` to the pivot,
and its cosine at most the cosine of that. Per query the cells with the best bounds that hold k
vectors are searched first; of the others only those whose bound reaches the k-th best cosine found.

Cells are stored in blocks of about ``BLOCK_ROWS`` vectors, so equal vectors, which share a cell,
fill several. Blocks meet the queries that ask for their cell in rows of about ``QUERY_CHUNK``
queries; a task sends k vectors per query and block at most. The same number of jobs runs for any
number of queries. Pivots, rings and their bounds do not grow with the data beyond ``MAX_PIVOTS``.

Defined results: null vectors and null ids are left out; a zero vector has cosine 0 with all;
vectors have one length and no nulls inside; among equal scores the larger id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.inverted_index import SCORE_PLACES, first_of_each, shuffle_parts
from tidemark.session import cut_lineage, working_path

MAX_PIVOTS = 512
RINGS = 64  # over half a turn
BLOCK_ROWS = 1024
QUERY_CHUNK = 256
_ZERO = -1  # cell of the zero vectors
_SLACK_ANGLE = 1e-7
_SLACK = 2e-9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of every row of a with every row of b; 0 for zero vectors."""
    norms = np.outer(np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1)))
    return np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


@dataclass
class Cells:
    """The pivots and, per cell, its number, its least and largest angle and its size."""

    pivots: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """Largest cosine possible, of queries × cells."""
        angle = _angle(_cosine(vectors, self.pivots)) if len(self.pivots) else np.zeros((len(vectors), 1))
        own = angle[:, np.maximum(self.number, 0) // RINGS]
        apart = np.maximum(own - self.high, self.low - own) - _SLACK_ANGLE
        found = np.cos(np.maximum(apart, 0)) + _SLACK
        found[:, self.number == _ZERO] = _SLACK
        found[(vectors == 0).all(axis=1)] = _SLACK
        return found


@dataclass
class VectorIndex:
    """Stored ``blocks``(cell, docs, values) and what is known of the cells."""

    blocks: DataFrame
    cells: Cells


def _written(df: DataFrame, name: str) -> DataFrame:
    path = working_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _block(group: pa.Table) -> pa.Table:
    group = group.combine_chunks()
    docs, values = group.column("doc_id").combine_chunks(), group.column("vector").combine_chunks().flatten()
    listed = [
        pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (docs, values)
    ]
    return pa.table({"cell": group.column("cell").slice(0, 1), "docs": listed[0], "values": listed[1]})


def build_index(docs: DataFrame, max_pivots: int = MAX_PIVOTS) -> VectorIndex:
    """Deals docs(doc_id, vector) to cells and stores them."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector")
    ).where("doc_id is not null and vector is not null")
    pivot_count = min(max_pivots, int(np.ceil(np.sqrt(rows.count()))))
    nonzero = rows.where(F.exists("vector", lambda x: x != 0))
    some = nonzero.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pivot_count).collect()
    pivots = np.array([r["vector"] for r in some], float)
    pivots = np.unique(pivots, axis=0) if len(pivots) else pivots

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cell, least = np.full(len(vectors), _ZERO), np.zeros(len(vectors))
            if len(pivots):
                angle = _angle(_cosine(vectors, pivots))
                nearest = angle.argmin(axis=1)
                least = angle[np.arange(len(angle)), nearest]
                ring = np.minimum(least * (RINGS / np.pi), RINGS - 1).astype(int)
                cell = np.where((vectors == 0).all(axis=1), _ZERO, nearest * RINGS + ring)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), batch.column("doc_id"), pa.array(least), batch.column("vector")],
                names=["cell", "doc_id", "angle", "vector"],
            )

    dealt = _written(
        rows.mapInArrow(deal, "cell int, doc_id long, angle double, vector array<double>"), "vector-cells"
    )
    # RINGS rows per pivot at most
    facts = dealt.groupBy("cell").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n")
    ).orderBy("cell").collect()
    parts = spark.createDataFrame([(r["cell"], -(-r["n"] // BLOCK_ROWS)) for r in facts], "cell int, parts long")
    split = dealt.join(F.broadcast(parts), "cell").select(
        "cell", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), "doc_id", "vector"
    )
    split = split.repartition(shuffle_parts(docs), "cell", "part")
    schema = "cell int, docs array<long>, values array<double>"
    blocks = _written(split.groupBy("cell", "part").applyInArrow(_block, schema), "vector-blocks")
    columns = ([r[c] for r in facts] for c in ("cell", "low", "high", "n"))
    number, low, high, size = (np.array(c) for c in columns)
    return VectorIndex(blocks, Cells(pivots, number.astype(int), low, high, size))


_PAIR = "query_id long, cell int, bound double, lead boolean"


def _cells_to_read(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, cell, bound, lead) of the leading cells, or, if queries have a ``floor``, of the
    others that reach it."""
    cells = index.cells
    second = "floor" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(cells.number):
                continue
            ids = batch.column("query_id").to_numpy()
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            bound = cells.bounds(vectors)
            order = np.argsort(-bound, axis=1, kind="stable")
            held = np.cumsum(cells.size[order], axis=1)
            leads = np.zeros(bound.shape, bool)
            np.put_along_axis(leads, order, np.c_[np.zeros(len(ids)), held[:, :-1]] < k, axis=1)
            chosen = leads
            if second:
                floor = batch.column("floor").fill_null(-2.0).to_numpy(zero_copy_only=False)
                chosen = ~leads & (bound >= floor[:, None])
            query, at = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[query]),
                    pa.array(cells.number[at], pa.int32()),
                    pa.array(bound[query, at]),
                    pa.array(leads[query, at]),
                ],
                names=["query_id", "cell", "bound", "lead"],
            )

    return queries.mapInArrow(run, _PAIR)


def _scored(index: VectorIndex, pairs: DataFrame, queries: DataFrame, k: int, chunks: int) -> DataFrame:
    """(query_id, doc_id, score): the k best of every block of given cells, without those below the
    query's ``floor`` if it has one."""
    parts = shuffle_parts(queries)
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks))
    asked = pairs.join(queries, "query_id").repartition(parts, "cell").groupBy("cell", chunk.alias("chunk"))
    floor = F.coalesce("floor", F.lit(-2.0)) if "floor" in queries.columns else F.lit(-2.0)
    asked = asked.agg(F.collect_list(F.struct("query_id", "vector", floor.alias("floor"))).alias("asked")).drop("chunk")
    met = index.blocks.repartition(parts, "cell").join(asked, "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch.column("docs")[row].values.to_numpy()
                values = batch.column("values")[row].values.to_numpy(zero_copy_only=False).reshape(len(docs), -1)
                ids, vectors, floor = batch.column("asked")[row].values.flatten()
                score = np.round(_cosine(_matrix(vectors, values.shape[1]), values), SCORE_PLACES)
                query, doc = np.nonzero(score >= floor.to_numpy()[:, None])
                score, doc = score[query, doc], docs[doc]
                kept = first_of_each(query, score, doc, k)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(query[kept])), pa.array(doc[kept]), pa.array(score[kept])],
                    names=["query_id", "doc_id", "score"],
                )

    return met.mapInArrow(run, "query_id long, doc_id long, score double")


@dataclass
class Search:
    """``read``(query_id, cell, bound, lead) are the cells that were searched, ``leaders`` the
    results (query_id, doc_id, score, rank)."""

    read: DataFrame
    leaders: DataFrame


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def search(index: VectorIndex, queries: DataFrame, k: int) -> Search:
    """The k nearest vectors of each of queries(query_id, vector)."""
    asked = cut_lineage(
        queries.select(
            F.col("query_id").cast("long").alias("query_id"),
            F.col("vector").cast("array<double>").alias("vector"),
        ).where("query_id is not null and vector is not null").dropDuplicates(["query_id"])
    )
    chunks = max(1, -(-asked.count() // QUERY_CHUNK))
    lead = _cells_to_read(index, asked, k)
    first = cut_lineage(_best(_scored(index, lead, asked, k, chunks), k))
    floors = first.where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("floor"))
    bounded = asked.join(floors, "query_id", "left")
    other = _cells_to_read(index, bounded, k)
    rest = _scored(index, other, bounded, k, chunks)
    return Search(lead.unionByName(other), _best(first.drop("rank").unionByName(rest), k))


def nearest(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k nearest of docs(doc_id, vector) per query."""
    return search(build_index(docs), queries, k).leaders
