"""Row-wise Arrow kernels over text columns, and the shared folder they write to.

Python runs on bounded slices of an Arrow batch (about ``SLICE_BYTES`` of text), so memory
depends on the longest text and not on the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidemark.session import working_path

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows, as texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    size = batch.column(column).nbytes
    step = max(1, batch.num_rows * SLICE_BYTES // max(size, 1))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(column).to_pylist()


def annotate(
    docs: DataFrame,
    make_kernel: Callable[[], Callable[[list], Sequence]],
    fields: list[StructField],
    text: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with new columns computed from ``text``, one output row per input row.

    ``make_kernel()`` runs once per task and returns a function from a list of texts to one
    sequence per field. An input column named like a new one is replaced by it; all other
    columns pass through untouched, the text itself only with ``keep_text``. An empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    new = {field.name.lower() for field in fields} | ({text.lower()} - {text.lower() * keep_text})
    passed = [field for field in docs.schema.fields if field.name.lower() not in new]
    schema = StructType([*passed, *fields])
    arrow = to_arrow_schema(schema)
    names = [field.name for field in passed]
    types = [arrow.field(field.name).type for field in fields]

    def run(batches):
        kernel = make_kernel()
        for whole in batches:
            for batch in slices(whole, text):
                made = kernel(texts_of(batch, text))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(name) for name in names]
                    + [pa.array(column, kind) for column, kind in zip(made, types, strict=True)],
                    names=[*names, *(field.name for field in fields)],
                )

    return docs.mapInArrow(run, schema)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: recovery starts from there, so the
    shuffle files of the write are removed as it ends."""
    path, conf = working_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
