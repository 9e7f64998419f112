"""Web archives, index first.

Writing: each task appends one gzip member per record to an archive file in the shared folder
and returns an index row per record (file, offset, length, URL, digest). The index is a Spark
table, so it lists exactly the records of the tasks that succeeded; files carry a random name,
and one that a lost task left behind is never read.

Reading: select rows of the index, sort them by file and offset, merge ranges that lie close
together, and read each merged range once.

Of records with equal payloads the one with the smallest page id is a response, the others
revisit it. Digests are grouped before payloads move; a payload that a third of all pages share
is one row per task there, and its revisits are dealt over salts.

Defined results: null html is an empty payload; a null URL is an empty one; repeated page ids
are records of their own, one with another URL revisits the first, rows equal in all are each
like the first; a null page id sorts last and is read back as null; other columns are not written; an empty table gives an
empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import bounded_batches, slices, written
from tidemark.session import working_path

FILE_BYTES = 1 << 30
READ_BYTES = 8 << 20  # of one merged range
GAP_BYTES = 64 << 10  # skipped rather than read apart
SALTS = 32
_DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time
_RECORD = "urn:tidemark:page:"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "page_id {id}, url string, file string, offset long, length long, payload_digest string, "
    "payload_bytes long, record_type string"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(page, url: str, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One record; a revisit holds the HTTP header only."""
    revisit = refers_to is not None
    block = _HTTP % size + (b"" if revisit else payload)
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_RECORD}{'' if page is None else page}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        headers += [f"WARC-Refers-To: <{_RECORD}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join([*headers, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record. A response's digest and size are taken from its payload, a revisit's
    from its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    page = fields["WARC-Record-ID"][1 + len(_RECORD) : -1]
    declared = re.search(rb"Content-Length: (\d+)", http)
    return {
        "page_id": int(page) if page else None,
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload": None if revisit else payload,
        "payload_bytes": int(declared[1]) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if revisit
        else payload_digest(payload),
        "refers_to": int(fields["WARC-Refers-To"][1 + len(_RECORD) : -1]) if revisit else None,
    }


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a shared path; local, HDFS and object stores alike."""
    uri = re.sub(r"^s3a:", "s3:", path)
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


@dataclass
class Archive:
    """Archive files of one task, in turn."""

    folder: str
    limit: int = FILE_BYTES
    file: str = ""
    offset: int = 0
    stream: object = field(default=None)

    def append(self, data: bytes) -> tuple[str, int, int]:
        if self.stream is None or self.offset + len(data) > self.limit:
            self.close()
            store, top = file_system(self.folder)
            store.create_dir(top, recursive=True)
            self.file, self.offset = f"{uuid.uuid4().hex}.warc.gz", 0
            self.stream = store.open_output_stream(f"{top}/{self.file}", compression=None)
        self.stream.write(data)
        self.offset += len(data)
        return self.file, self.offset - len(data), len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, _row, refers_to) of the pages that revisit another. Only ids and digests are
    grouped; ``_row`` tells apart rows that repeat an id."""
    marks = pages.select("page_id", "_row", "_digest", F.octet_length("_payload").alias("_bytes"))
    marks = marks.where(F.col("_bytes") >= least_bytes)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row")
    first = marks.groupBy("_digest", "_bytes").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = marks.withColumn("salt", F.pmod(F.xxhash64("_row", "page_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(first, ["_digest", "_bytes", "salt"])
    return found.where(~order.eqNullSafe(F.col("first"))).select(
        "page_id", "_row", F.col("first.page_id").alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes=FILE_BYTES) -> DataFrame:
    """Writes a record per page and returns the index, itself a table in the shared folder."""
    bounded_batches(pages.sparkSession)
    id_type = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(
        "page_id",
        F.coalesce("url", F.lit("")).alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("_payload"),
    )
    rows = rows.withColumn("_digest", F.sha1("_payload")).withColumn(
        "_row", F.xxhash64("url", "_digest")
    )
    again = revisits(rows, least_bytes).select(
        F.col("page_id").alias("_page"), F.col("_row").alias("_again"), "refers_to"
    ).distinct()
    decided = rows.join(
        again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_row") == F.col("_again")), "left"
    ).select(
        "page_id", "url", "refers_to", "_digest", F.octet_length("_payload").cast("long").alias("_bytes"),
        # a revisit's payload is not needed any more
        F.when(F.col("refers_to").isNull(), F.col("_payload")).alias("_payload"),
    )

    def run(batches) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder, file_bytes)
        for whole in batches:
            kind = whole.schema.field("page_id").type
            for batch in slices(whole, "_payload"):
                made = []
                for page, url, refers, digest, size, payload in zip(
                    *(column.to_pylist() for column in batch.columns), strict=True
                ):
                    name = base64.b32encode(bytes.fromhex(digest)).decode()
                    data = _member(record(page, url, payload or b"", size, name, refers))
                    place = archive.append(data)
                    kept = "response" if refers is None else "revisit"
                    made.append((page, url, *place, name, size, kept))
                columns = list(zip(*made, strict=True)) or [()] * 8
                types = [
                    kind, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(),
                    pa.string(),
                ]
                names = [
                    "page_id", "url", "file", "offset", "length", "payload_digest", "payload_bytes",
                    "record_type",
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
                )
        archive.close()

    return written(decided.mapInArrow(run, INDEX.format(id=id_type)), "warc-index")


def ranges(rows, limit: int = READ_BYTES, gap: int = GAP_BYTES):
    """Merges sorted (file, offset, length) rows into (file, begin, end, rows) to read at once."""
    current = None
    for file, offset, length in rows:
        end = offset + length
        if (
            current
            and current[0] == file
            and offset - current[2] <= gap
            and end - current[1] <= limit
        ):
            current[2] = max(current[2], end)
            current[3].append((offset, length))
        else:
            if current:
                yield tuple(current)
            current = [file, offset, end, [(offset, length)]]
    if current:
        yield tuple(current)


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the selected index rows.

    Rows are dealt by file and stretch of the file, so that neighbours meet in one task and a
    large file is read by many.
    """
    spark = selected.sparkSession
    bounded_batches(spark)
    stretch = F.floor(F.col("offset") / F.lit(READ_BYTES))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = (
        selected.select("file", "offset", "length")
        .repartition(partitions, "file", stretch)
        .sortWithinPartitions("file", "offset")
    )
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    schema = (
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to long" + (", payload binary" if payloads else "")
    )
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [*names, *(["payload"] if payloads else [])]

    def listed(batches):
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    def run(batches):
        store, top = file_system(folder)
        for file, begin, end, rows in ranges(listed(batches)):
            with store.open_input_file(f"{top}/{file}") as stream:
                stream.seek(begin)
                data = stream.read(end - begin)
            made = [
                parse(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                for offset, length in rows
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[n] for m in made], t) for n, t in zip(names, types, strict=False)],
                names=names,
            )

    return places.mapInArrow(run, schema)


def archive_folder(spark: SparkSession) -> str:
    return working_path(spark, "warc")
