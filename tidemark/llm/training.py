"""Bounded training samples: texts are turned into sparse rows on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import bounded_batches, slices, texts_of
from tidemark.llm.linear import Matrix, sparse_rows

_SCHEMA = "key string, features binary, weights binary, targets array<int>"


def sparse_sample(
    docs: DataFrame, chosen: DataFrame, targets: list[str], id_col="doc_id", text="text",
    features=sparse_rows,
) -> tuple[Matrix, np.ndarray]:
    """Features and targets of the chosen documents, ordered by hash of the id.

    ``chosen`` has one row per sampled id with its targets and a bounded number of rows, so it
    is broadcast and what reaches the driver is bounded too. Repeated ids and texts count as
    often as they occur.
    """
    bounded_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("sampled_id"), F.col(text).alias("text")).join(
        F.broadcast(
            chosen.select(
                F.col(id_col).alias("sampled_id"),
                F.array(*(F.col(t).cast("int") for t in targets)).alias("targets"),
            )
        ),
        "sampled_id",
    )
    picked = picked.select(F.col("sampled_id").cast("string").alias("key"), "text", "targets")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = features(texts_of(batch, "text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"),
                        pa.array([f.astype(np.int32).tobytes() for f, _ in rows], pa.binary()),
                        pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary()),
                        batch.column("targets"),
                    ],
                    names=["key", "features", "weights", "targets"],
                )

    table = picked.mapInArrow(run, _SCHEMA).toArrow()
    if not table.num_rows:
        return Matrix.of([]), np.empty((0, len(targets)), np.int64)
    found = sorted(
        zip(*(table.column(c).to_pylist() for c in table.column_names), strict=True),
        key=lambda row: (hash_key(row[0]), row[0], row[1], row[2]),
    )
    del table
    pairs = [
        (np.frombuffer(f, np.int32), np.frombuffer(v, np.float32)) for _, f, v, _ in found
    ]
    return Matrix.of(pairs), np.array([t for *_, t in found]).reshape(len(found), len(targets))


def hash_key(key: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(key.encode())
