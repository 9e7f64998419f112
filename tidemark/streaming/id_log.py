"""A log of ids by date that micro-batches ask and add to, at a cost that does not grow with them.

Each date has a folder of runs. A micro-batch adds a run of the first level; ``FANOUT`` runs of a
level become one of the next, so a date has at most ``FANOUT`` - 1 of each level and the number of
levels is logarithmic in the number of batches. Only the folders of the dates asked for are listed.
Beside the ids stands a Bloom sketch per date, in runs of the same kind: words of 64 bits, merged by
bitwise or. Ids of a date are read only if its sketch knows some id of the batch; a full sketch
knows all of them, which costs time but loses nothing.

Recovery: adding a batch again adds ids that are there already, which changes no answer. A merged
run counts once its success marker stands, and from then on the runs it covers do not; they are
removed afterwards. A merge that dies leaves them in force.

Ids without a date have a folder of their own, which is always read.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import names_in, path_exists, remove

FANOUT = 8
HASHES = 3
#: Bits of a date's sketch: about 13 million ids at one false answer in thirty. Only words with a
#: bit are stored, so a date of few ids has a small sketch.
SKETCH_BITS = 1 << 26

_UNDATED = "event_date=__HIVE_DEFAULT_PARTITION__"
_RUN = re.compile(r"run=L(\d+)-(\d+)-(\d+)")
_IDS = "event_id string"
_WORDS = "word long, bits long"


def _folder(date) -> str:
    return _UNDATED if date is None else f"event_date={date}"


def runs(spark: SparkSession, part: str, folder: str) -> list[tuple[int, int, int, str]]:
    """(level, first batch, last batch, path) of the runs of one date that are in force."""
    top = f"{part}/{folder}"
    found = [(name, _RUN.fullmatch(name)) for name in names_in(spark, top)]
    held = [(*map(int, m.groups()), f"{top}/{name}") for name, m in found if m]
    whole = [r for r in held if r[0] == 0 or path_exists(spark, f"{r[3]}/_SUCCESS")]
    covered = lambda r: any(
        w[0] > r[0] and w[1] <= r[1] and r[2] <= w[2] for w in whole
    )
    return sorted(r for r in whole if not covered(r))


def _paths(spark: SparkSession, part: str, folders: list[str]) -> list[str]:
    return [run[3] for folder in folders for run in runs(spark, part, folder)]


def _places(ids: DataFrame, bits: int) -> DataFrame:
    """(event_date, event_id, word, bit): where the sketch marks an id."""
    hashes = F.array(
        *(F.pmod(F.xxhash64(F.lit(k), F.col("event_id")), F.lit(bits)) for k in range(HASHES))
    )
    placed = ids.select("event_date", "event_id", F.explode(hashes).alias("place"))
    return placed.select(
        "event_date", "event_id",
        F.shiftright("place", 6).alias("word"),
        F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bit"),
    )


def possible_dates(batch: DataFrame, log: str, dates: list, bits: int = SKETCH_BITS) -> list:
    """Those of ``dates`` whose sketch may hold an id that the batch has under that date."""
    spark = batch.sparkSession
    paths = _paths(spark, f"{log}/sketch", [_folder(d) for d in dates if d is not None])
    if not paths:
        return []
    sketch = (
        spark.read.schema(f"{_WORDS}, event_date date").option("basePath", f"{log}/sketch")
        .parquet(*paths).groupBy("event_date", "word").agg(F.bit_or("bits").alias("bits"))
    )
    asked = _places(batch.where("event_id IS NOT NULL").select("event_date", "event_id").distinct(), bits)
    hit = asked.join(sketch, ["event_date", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    missed = F.expr("count(DISTINCT word, bit)")
    needed = asked.groupBy("event_date", "event_id").agg(missed.alias("n"))
    marked = hit.groupBy("event_date", "event_id").agg(missed.alias("n"))
    maybe = marked.join(needed, ["event_date", "event_id", "n"]).select("event_date").distinct()
    return sorted(r[0] for r in maybe.collect())  # at most the dates of the batch


def held_ids(batch: DataFrame, log: str, bits: int = SKETCH_BITS) -> DataFrame | None:
    """The logged ids of the dates that matter to the batch; None if there are none."""
    spark = batch.sparkSession
    dates = [r[0] for r in batch.select("event_date").distinct().collect()]  # calendar days
    folders = [_folder(d) for d in possible_dates(batch, log, dates, bits)] + [_UNDATED]
    paths = _paths(spark, f"{log}/ids", folders)
    return spark.read.schema(_IDS).parquet(*paths) if paths else None


def add(rows: DataFrame, log: str, batch_id: int, bits: int = SKETCH_BITS, fanout: int = FANOUT) -> None:
    """Adds (event_date, event_id) of a batch and merges the runs that have become too many."""
    spark = rows.sparkSession
    run = F.lit(f"L0-{batch_id}-{batch_id}").alias("run")
    ids = rows.select("event_date", "event_id")
    words = _places(ids, bits).groupBy("event_date", "word").agg(F.bit_or("bit").alias("bits"))
    for part, made in (("ids", ids), ("sketch", words)):
        made.select("*", run).write.mode("append").partitionBy("event_date", "run").parquet(
            f"{log}/{part}"
        )
    for (date,) in ids.select("event_date").distinct().collect():
        merge(spark, f"{log}/ids", _folder(date), _IDS, fanout)
        merge(spark, f"{log}/sketch", _folder(date), _WORDS, fanout)


def merge(spark: SparkSession, part: str, folder: str, schema: str, fanout: int) -> None:
    """Level by level: ``fanout`` runs of one level become a run of the next."""
    while True:
        levels = defaultdict(list)
        for one in runs(spark, part, folder):
            levels[one[0]].append(one)
        full = [level for level, own in sorted(levels.items()) if len(own) >= fanout]
        if not full:
            return
        own = levels[full[0]]
        first, last = min(r[1] for r in own), max(r[2] for r in own)
        rows = spark.read.schema(schema).parquet(*(r[3] for r in own))
        if schema == _WORDS:
            rows = rows.groupBy("word").agg(F.bit_or("bits").alias("bits"))
        else:
            rows = rows.hint("rebalance")
        rows.write.mode("overwrite").parquet(f"{part}/{folder}/run=L{full[0] + 1}-{first}-{last}")
        for one in own:
            remove(spark, one[3])
