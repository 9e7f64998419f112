"""Shortest-pack-first packing over the length histogram.

Lengths are placed from long to short. Each piece goes into the shortest pack so far, the one
with the most room, or into a new one if it does not fit; packs with equal contents are one
pattern with a count, so the work depends on the histogram, which has at most ``limit`` entries,
and not on the corpus. Documents longer than the limit are cut into full pieces and a rest first.

Patterns that are neither full nor a power of two long would be padded. As documents may be cut
anywhere, the fullest of them are filled up with the tokens of the emptiest, which are taken
apart: pieces of those lie on one line in order of length, the room of the others lies on a second
line, largest first, and where a boundary of either falls inside a piece the piece is cut. What
remains of the first line, less than a sequence, is cut into powers of two. So nothing is padded,
and whole documents are cut only for room that no whole piece had filled.

Patterns are joined back to documents by rank: the number of a piece among all of its length is
its place in its task's output plus the count of the tasks before. No task sees all pieces of a
length, and rank arithmetic replaces any list of pieces. Full pieces are sequences by themselves,
numbered below zero by task and place; they need no rank and are not shuffled.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; a null
id is kept; of the input only the id and the text are read; an empty table gives an empty packing.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import bounded_batches, slices, texts_of, written
from tidemark.llm.token_counts import byte_encoding, default_path

LIMIT = 1024
END_ID = 0

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def fill_of(pattern: Pattern) -> int:
    return sum(length * copies for length, copies in pattern)


def _with(pattern: Pattern, length: int) -> Pattern:
    if pattern and pattern[-1][0] == length:
        return (*pattern[:-1], (length, pattern[-1][1] + 1))
    return (*pattern, (length, 1))


def shortest_pack_first(histogram: dict[int, int], limit: int = LIMIT) -> Counter:
    """Patterns with the number of packs of each, as if every piece were placed in turn."""
    by_room: list[Counter] = [Counter() for _ in range(limit + 1)]
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], limit
        while left:
            while room >= length and not by_room[room]:
                room -= 1
            if room < length:
                fits = limit // length
                for copies, packs in ((fits, left // fits), (left % fits, 1)):
                    if copies and packs:
                        by_room[limit - copies * length][((length, copies),)] += packs
                break
            pattern, packs = next(iter(by_room[room].items()))
            used = min(packs, left)
            by_room[room][pattern] -= used
            if used == packs:
                del by_room[room][pattern]
            by_room[room - length][_with(pattern, length)] += used
            left -= used
    total: Counter = Counter()
    for held in by_room:
        total.update(held)
    return total


@dataclass
class Plan:
    """Where pieces go, by length and rank.

    ``kept`` holds (length, first rank, sequence, copies, offset) of the patterns that stay whole,
    ``line`` (length, first rank, place) of those that are taken apart, ``room`` (place, size,
    sequence, offset) of what is filled from the line, equal sizes in a row.
    """

    limit: int
    kept: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    line: list[tuple[int, int, int]] = field(default_factory=list)
    room: list[tuple[int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def __post_init__(self):
        self._index()

    def _index(self) -> None:
        self.slots: dict[int, tuple[list, list]] = {}
        for row in (*self.kept, *self.line):
            self.slots.setdefault(row[0], ([], []))[1].append(row)
        for ranks, rows in self.slots.values():
            rows.sort(key=lambda row: row[1])
            ranks.extend(row[1] for row in rows)
        self.places = [row[0] for row in self.room]

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(first token, length, sequence, offset) of the parts of a piece."""
        ranks, rows = self.slots[length]
        row = rows[bisect_right(ranks, rank) - 1]
        copy = rank - row[1]
        if len(row) == 5:
            return [(0, length, row[2] + copy // row[3], row[4] + copy % row[3] * length)]
        begin = at = row[2] + copy * length
        made = []
        while at < begin + length:
            place, size, sequence, offset = self.room[bisect_right(self.places, at) - 1]
            number, inside = divmod(at - place, size)
            end = min(begin + length, at + size - inside)
            made.append((at - begin, end - at, sequence + number, offset + inside))
            at = end
        return made


def solve(histogram: dict[int, int], limit: int = LIMIT) -> Plan:
    packs = shortest_pack_first(histogram, limit)
    closed, open_packs = [], []
    for pattern, count in packs.items():
        fill = fill_of(pattern)
        (closed if fill == limit or fill & (fill - 1) == 0 else open_packs).append((fill, pattern, count))
    open_packs.sort(reverse=True)
    tokens = sum(fill * count for fill, _, count in open_packs)
    whole, rest = divmod(tokens, limit)
    plan, seen, taken_apart, filled = Plan(limit), Counter(), [], []

    def keep(pattern: Pattern, count: int) -> None:
        offset = 0
        for length, copies in pattern:
            plan.kept.append((length, seen[length], plan.sequences, copies, offset))
            seen[length] += count * copies
            offset += length * copies
        plan.sequences += count

    for _, pattern, count in closed:
        keep(pattern, count)
    for fill, pattern, count in open_packs:
        kept = min(count, whole)
        whole -= kept
        if kept:
            filled.append((limit - fill, plan.sequences, fill, kept))
            keep(pattern, kept)
        if count > kept:
            taken_apart += [(length, copies * (count - kept)) for length, copies in pattern]
    place = 0
    for length, count in sorted(taken_apart, reverse=True):
        plan.line.append((length, seen[length], place))
        seen[length] += count
        place += length * count
    place = 0
    for size, sequence, offset, count in sorted(filled, reverse=True):
        plan.room.append((place, size, sequence, offset))
        place += size * count
    # whole sequences that no pattern was left for, then powers of two
    sizes = [(limit, whole), *((1 << k, rest >> k & 1) for k in range(limit.bit_length(), -1, -1))]
    for size, count in sizes:
        if count:
            plan.room.append((place, size, plan.sequences, 0))
            plan.sequences += count
            place += size * count
    plan._index()
    return plan


_PIECE = "doc_id {id}, start long, length long, doc_tokens long, ids binary, part int, place long"


def tokenized(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Pieces of all documents, written once: ids as little-endian 32-bit numbers, and the
    piece's place among those of its length in its part. ``path`` is a file of byte-level ranks."""
    bounded_batches(docs.sparkSession)
    path = path or default_path()
    rows = docs.select("doc_id", "text")
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "part", "place"]

    def run(batches):
        part = TaskContext.get().partitionId()
        places: Counter = Counter()
        encode = byte_encoding(path).encode_ordinary
        for whole in batches:
            types = [whole.schema.field("doc_id").type, *[pa.int64()] * 3, pa.binary(), pa.int32(), pa.int64()]
            for batch in slices(whole, "text"):
                made = []
                ids = batch.column("doc_id").to_pylist()
                for doc, text in zip(ids, texts_of(batch, "text"), strict=True):
                    own = array("I", encode(text) if text else ())
                    own.append(END_ID)
                    data = np.asarray(own, "<u4").tobytes()
                    for start in range(0, len(own), limit):
                        length = min(limit, len(own) - start)
                        piece = data[4 * start : 4 * (start + length)]
                        made.append((doc, start, length, len(own), piece, part, places[length]))
                        places[length] += 1
                columns = list(zip(*made, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
                )

    schema = _PIECE.format(id=rows.schema["doc_id"].dataType.simpleString())
    return written(rows.mapInArrow(run, schema), "spf-pieces", compression="zstd")


_CUT = "array<struct<first: long, length: long, sequence_id: long, offset: long>>"


def packed(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Final pieces with ``ids``, ``doc_tokens``, ``sequence_id`` and ``offset``."""
    columns = ["doc_id", "start", "length", "ids", "doc_tokens"]
    number = -1 - (F.shiftleft(F.col("part").cast("long"), 40) + F.col("place"))
    full = pieces.where(F.col("length") == limit).select(
        *columns, number.alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    pieces = pieces.where(F.col("length") < limit)
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("pieces"))
    histogram = {
        row["length"]: row["pieces"]
        for row in counts.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()
    }
    # patterns are bounded by the limit, whatever the corpus holds
    plan = pieces.sparkSession.sparkContext.broadcast(solve(histogram, limit))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "part", "length", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("_base")
    )
    ranked = pieces.join(bases, ["part", "length"]).withColumn("_rank", F.col("place") + F.col("_base"))

    @F.arrow_udf(_CUT)
    def cut(length: pa.Array, rank: pa.Array) -> pa.Array:
        find = plan.value.pieces
        names = ("first", "length", "sequence_id", "offset")
        rows = [
            [dict(zip(names, c, strict=True)) for c in find(n, r)]
            for n, r in zip(length.to_pylist(), rank.to_pylist(), strict=True)
        ]
        return pa.array(rows, pa.list_(pa.struct([(name, pa.int64()) for name in names])))

    parts = ranked.withColumn("_cut", F.explode(cut("length", "_rank")))
    first, length = F.col("_cut.first"), F.col("_cut.length")
    placed = parts.select(
        "doc_id",
        (F.col("start") + first).alias("start"),
        length.alias("length"),
        F.substring("ids", (4 * first + 1).cast("int"), (4 * length).cast("int")).alias("ids"),
        "doc_tokens",
        "_cut.sequence_id",
        "_cut.offset",
    )
    return full.unionByName(placed)


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Pieces of all documents with their ids and places."""
    return packed(tokenized(docs, path, limit), limit)


def padding(placed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row: sequences, tokens and padded tokens, if all but powers of two are padded."""
    fill = placed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    whole = F.col("fill").bitwiseAND(F.col("fill") - 1) == 0
    return fill.agg(
        F.count("*").alias("sequences"),
        F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(whole, 0).otherwise(limit - F.col("fill"))), F.lit(0)).alias("padded"),
    )
