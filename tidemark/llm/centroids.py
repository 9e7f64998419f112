"""Centroid clustering in whole numbers with an equal-average equal-variance search.

Lloyd's rounds: every vector goes to its nearest centroid, then every centroid that has vectors
moves to their mean, rounded down per component. To find the nearest, centroids are sorted by
their component mean and looked at outward from the vector's mean. For ``d`` components with
means ``m`` and deviations ``s`` from them, ``d * distance >= (d * gap of m) ** 2`` ends the
search of a vector, and ``d * distance >= (d * gap of m) ** 2 + d * (gap of s) ** 2`` spares a
centroid its distance. Both are tested in floating point with a margin above its error, and what
they leave is measured exactly in integers, so the result is that of comparing all.

A round is one scan: tasks send the sums of their vectors per centroid, ``k * d`` numbers each, so
vectors that are equal or crowd around one centroid shift nothing. Only centroids reach the
driver. Sums of a round are decimals and can't overflow.

Defined results: rows without exactly ``dimensions`` finite components are left out, as are their
ids; repeated rows count each; a vector with a null id is assigned and counted but never a start;
starts with equal ids are taken in the order of their components; with fewer vectors than ``k``
there are fewer centroids; ties go to the smaller centroid; a component beyond ``LARGEST`` steps
raises, as distances would not fit 64 bits; only the id and the vector are read of the input; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import written

CENTROIDS = 40
ROUNDS = 5
DIMENSIONS = 64
STEPS = 256  # of a unit
SALT = "2:"
LARGEST = 1 << 26  # 2 ** 54 is the largest square of a difference, for up to 256 components
ROWS = 4096  # vectors searched together
MARGIN = 1e-9


@dataclass
class Centroids:
    """The centroids in the order of their means."""

    values: np.ndarray  # (k, d) integers, by number

    def __post_init__(self):
        sums = self.values.sum(axis=1)
        self.number = np.argsort(sums, kind="stable")
        self.sorted = self.values[self.number]
        self.sums = sums[self.number].astype(np.float64)
        self.spread, self.size = _shape(self.sorted)
        self.measured = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid of each vector."""
        n, d = vectors.shape
        k = len(self.values)
        sums = vectors.sum(axis=1).astype(np.float64)
        spread, size = _shape(vectors)
        best = np.full(n, np.iinfo(np.int64).max)
        label = np.full(n, k)
        padded = np.concatenate([[-np.inf], self.sums, [np.inf]])
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        open_rows = np.arange(n)
        while len(open_rows):
            below = sums[open_rows] - padded[down + 1]
            above = padded[up + 1] - sums[open_rows]
            upward = above <= below
            gap = np.minimum(above, below)
            reach = d * (1 + MARGIN) * best[open_rows]
            near = (gap < np.inf) & (gap * gap <= reach)
            open_rows, up, down, upward, gap = (x[near] for x in (open_rows, up, down, upward, gap))
            at = np.where(upward, up, down)
            up, down = up + upward, down - ~upward
            loose = MARGIN * (size[open_rows] + self.size[at])
            apart = np.maximum(0, np.abs(spread[open_rows] - self.spread[at]) - loose)
            left = gap * gap + d * apart * apart <= reach[near]
            rows, which = open_rows[left], at[left]
            self.measured += len(rows)
            distance = ((vectors[rows] - self.sorted[which]) ** 2).sum(axis=1)
            number = self.number[which]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < label[rows]))
            best[rows[better]], label[rows[better]] = distance[better], number[better]
        return label, best


def _shape(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the deviation from the mean, and length of the vector itself."""
    centred = vectors - vectors.mean(axis=1, keepdims=True)
    return np.linalg.norm(centred, axis=1), np.linalg.norm(vectors.astype(np.float64), axis=1)


def _whole(batch: pa.RecordBatch, vector: str, dimensions: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and integers of the vectors of a batch that count."""
    column = batch.column(vector)
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    finite = np.isfinite(values).all(axis=1)
    scaled = np.floor(values[finite] * steps)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is over {LARGEST} steps")
    return rows[finite], scaled.astype(np.int64)


def _starts(vectors: DataFrame, vector: str, dimensions: int, steps: int, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids."""

    def run(batches):
        for batch in batches:
            rows, values = _whole(batch, vector, dimensions, steps)
            ids = batch.column("_id").take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(list(values), pa.list_(pa.int64()))], names=["_id", "_values"]
            )

    known = vectors.where(F.col("_id").isNotNull())
    found = known.mapInArrow(run, f"_id {vectors.schema['_id'].dataType.simpleString()}, _values array<long>")
    digest = F.sha2(F.concat(F.lit(salt), F.col("_id").cast("string")), 256)
    first = found.orderBy(digest, "_values").limit(k).collect()
    return np.array([row["_values"] for row in first], np.int64).reshape(-1, dimensions)


def _moved(vectors: DataFrame, vector: str, dimensions: int, steps: int, values: np.ndarray) -> np.ndarray:
    """The centroids after one round."""

    def run(batches):
        centroids = Centroids(values)
        counts, sums = np.zeros(len(values), np.int64), np.zeros(values.shape, np.int64)
        for batch in batches:
            _, own = _whole(batch, vector, dimensions, steps)
            for start in range(0, len(own), ROWS):
                part = own[start : start + ROWS]
                label, _ = centroids.nearest(part)
                counts += np.bincount(label, minlength=len(values))
                np.add.at(sums, label, part)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    parts = vectors.select(vector).mapInArrow(run, "cluster long, n long, sums array<long>")
    whole = (
        parts.select("cluster", "n", F.posexplode("sums").alias("component", "sum"))
        .groupBy("cluster", "component")
        .agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n"))
    )
    moved = values.copy()
    for row in whole.collect():  # k * d rows at most
        moved[row["cluster"], row["component"]] = int(row["sum"]) // row["n"]
    return moved


def fit(
    vectors: DataFrame, k: int, rounds: int, dimensions: int, steps: int, salt: str, vector: str
) -> np.ndarray:
    """The centroids after all rounds; rounds that would change nothing are left out."""
    values = _starts(vectors, vector, dimensions, steps, k, salt)
    for _ in range(rounds if len(values) else 0):
        moved = _moved(vectors, vector, dimensions, steps, values)
        if (moved == values).all():
            break
        values = moved
    return values


def cluster(
    table: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    steps: int = STEPS,
    salt: str = SALT,
) -> DataFrame:
    """Per vector: its id, ``cluster``, squared ``distance`` in steps, the ``centroid`` itself,
    ``cluster_inertia`` and ``inertia``."""
    if k < 1 or rounds < 0 or not 1 <= dimensions <= 256:
        raise ValueError("k, rounds or dimensions out of range")
    vectors = table.select(F.col(id_column).alias("_id"), F.col(vector).alias("_vector"))
    values = fit(vectors, k, rounds, dimensions, steps, salt, "_vector")

    def run(batches):
        centroids = Centroids(values) if len(values) else None
        for batch in batches:
            rows, own = _whole(batch, "_vector", dimensions, steps)
            if centroids is None:  # there are no vectors, or none has an id
                rows, own = rows[:0], own[:0]
            for start in range(0, len(own), ROWS):
                label, distance = centroids.nearest(own[start : start + ROWS])
                ids = batch.column("_id").take(pa.array(rows[start : start + ROWS]))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(label, pa.int32()), pa.array(distance)], names=["_id", "cluster", "distance"]
                )

    kind = vectors.schema["_id"].dataType.simpleString()
    assigned = written(
        vectors.mapInArrow(run, f"_id {kind}, cluster int, distance long"), "clusters"
    )
    per_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    sums = {row["cluster"]: int(row["sum"]) for row in per_cluster.collect()}  # k rows at most
    total = sum(sums.values())
    rows = [(c, values[c].tolist(), s, total) for c, s in sums.items()]
    facts = table.sparkSession.createDataFrame(
        rows, "cluster int, centroid array<long>, cluster_inertia long, inertia long"
    )
    return assigned.join(F.broadcast(facts), "cluster").select(
        F.col("_id").alias(id_column), "cluster", "distance", "centroid", "cluster_inertia", "inertia"
    )
