"""Best-fit packing by a configuration linear program over the length histogram.

Variables count how often a configuration (a multiset of lengths that fits a sequence) is used;
every length must be covered as often as it occurs. Multiplicative weights solve it: a length's
price falls as its demand is covered, knapsack dynamic programming over the prices finds the best
configuration around every length, and those close to the best are used in whole numbers of
sequences, a share of what their scarcest length still allows. So the solution is rounded as it
grows; the remainder, at most a few pieces per length, is packed best fit decreasing. Prices also
give a lower bound on the number of sequences.

The histogram has at most ``limit`` entries whatever the corpus holds, so the driver solves it.
Documents are cut, tokenised and numbered per task and length in one pass into the shared
folder; pieces then find their configuration by rank. No task sees all pieces of a length.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; a null
id is kept; of the input only the id, the text and the columns asked for are read; an empty
table gives an empty packing.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import bounded_batches, slices, texts_of, written
from tidemark.llm.tokens import encoder, tokenizer_path

LIMIT = 2048
END_ID = 0
ROUNDS = 400
LEARNING_RATE = 0.1
SHARE = 1.0  # of what the scarcest length of a configuration still allows
TOLERANCE = 0.01
REPACKED = (0.02, 0.1, 0.3)  # shares of the sequences tried for packing with the remainder

Configuration = tuple[tuple[int, int], ...]  # (length, copies), longest first


@dataclass
class Plan:
    """Configurations with the number of sequences of each, and a bound from the prices."""

    uses: list[tuple[Configuration, int]]
    lower_bound: int

    @property
    def sequences(self) -> int:
        return sum(count for _, count in self.uses)


def knapsack(prices: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity, and the last length taken for it (0: none). ``prices`` is
    indexed by length, with -inf where there is none."""
    best = np.zeros(limit + 1)
    taken = np.zeros(limit + 1, np.int64)
    for capacity in range(1, limit + 1):
        values = prices[1 : capacity + 1] + best[capacity - 1 :: -1][:capacity]
        k = int(values.argmax())
        if values[k] > best[capacity - 1]:
            best[capacity], taken[capacity] = values[k], k + 1
        else:
            best[capacity], taken[capacity] = best[capacity - 1], 0
    return best, taken


def _around(length: int, taken: np.ndarray, limit: int) -> Counter:
    """The best configuration that holds ``length``."""
    found, room = Counter([length]), limit - length
    while room > 0:
        if taken[room]:
            found[int(taken[room])] += 1
            room -= int(taken[room])
        else:
            room -= 1
    return found


def best_fit_decreasing(left: dict[int, int], limit: int) -> Counter:
    """Packs pieces from long to short into the fullest sequence with room, equal sequences
    together."""
    open_by_room: dict[int, Counter] = {}
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            room = min((r for r, held in open_by_room.items() if r >= length and held), default=0)
            if not room:
                fits = limit // length
                for copies, number in ((fits, count // fits), (count % fits, 1)):
                    if copies and number:
                        rest = limit - copies * length
                        open_by_room.setdefault(rest, Counter())[((length, copies),)] += number
                break
            content, number = next(iter(open_by_room[room].items()))
            copies = min(room // length, count)
            used = min(number, count // copies)
            held = open_by_room[room]
            held[content] -= used
            if not held[content]:
                del held[content]
            grown = (*content, (length, copies))
            open_by_room.setdefault(room - copies * length, Counter())[grown] += used
            count -= used * copies
    total: Counter = Counter()
    for held in open_by_room.values():
        total.update(held)
    return total


def solve(histogram: dict[int, int], limit: int = LIMIT, rounds: int = ROUNDS) -> Plan:
    demand = np.zeros(limit + 1, np.int64)
    for length, count in histogram.items():
        demand[length] = count
    left = demand.copy()
    uses: Counter = Counter()
    bound = -(-int((demand * np.arange(limit + 1)).sum()) // limit)
    bound = max(bound, int(demand[limit // 2 + 1 :].sum()))
    material = np.arange(limit + 1) / limit
    for _ in range(rounds):
        if not left.any():
            break
        covered = 1 - left / np.maximum(demand, 1)
        price = np.where(left > 0, material * np.exp(-LEARNING_RATE * covered), -np.inf)
        best, taken = knapsack(price, limit)
        priced = np.where(demand > 0, material * np.exp(-LEARNING_RATE * covered), 0.0)
        if not (demand[left == 0] > 0).any():  # all lengths were open to the knapsack
            bound = max(bound, int(np.ceil((demand * priced).sum() / best[limit] - 1e-6)))
        used = 0
        for length in np.flatnonzero(left)[::-1].tolist():
            if not left[length] or price[length] + best[limit - length] < best[limit] * (1 - TOLERANCE):
                continue
            found = _around(length, taken, limit)
            possible = min(int(left[k]) // copies for k, copies in found.items())
            count = min(possible, max(1, int(possible * SHARE))) if possible else 0
            if count:
                uses[tuple(sorted(found.items(), reverse=True))] += count
                for k, copies in found.items():
                    left[k] -= count * copies
                used += count
        if not used:
            break
    remainder = {int(k): int(left[k]) for k in np.flatnonzero(left)}
    best_uses = rounded(uses, remainder, limit, 0.0)
    for share in REPACKED:
        tried = rounded(uses, remainder, limit, share)
        best_uses = min(best_uses, tried, key=lambda u: sum(u.values()))
    return Plan(sorted(best_uses.items(), reverse=True), bound)


def rounded(uses: Counter, remainder: dict[int, int], limit: int, share: float) -> Counter:
    """Packs the remainder together with the pieces of the sequences used last, whose lengths
    were scarce by then, and of all that have room left."""
    kept, pool = Counter(), Counter(remainder)
    spared = (1 - share) * sum(uses.values())
    seen = 0
    for configuration, count in uses.items():  # in the order of their first use
        full = sum(length * copies for length, copies in configuration) == limit
        stay = count if not share else int(min(count, max(0, spared - seen))) * full
        seen += count
        if stay:
            kept[configuration] += stay
        for length, copies in configuration:
            if count > stay:
                pool[length] += copies * (count - stay)
    return kept + best_fit_decreasing(pool, limit)


_PIECE = "doc_id {id}, piece int, start long, length long, ids binary, part int, place long"


def tokenized(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Pieces of all documents, written once: ids as little-endian 32-bit numbers, and the
    piece's place among those of its length in its part."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or tokenizer_path()
    rows = docs.select("doc_id", "text")
    schema = _PIECE.format(id=rows.schema["doc_id"].dataType.simpleString())

    def run(batches):
        part = TaskContext.get().partitionId()
        places: Counter = Counter()
        for whole in batches:
            id_type = whole.schema.field("doc_id").type
            for batch in slices(whole, "text"):
                flat, counts = encoder(path).encode(texts_of(batch, "text"))
                ends = np.cumsum(counts)
                data = np.insert(flat, ends, END_ID).astype("<u4").tobytes()
                begins = ends - counts + np.arange(len(counts))
                made = []
                ids = batch.column("doc_id").to_pylist()
                for doc, begin, size in zip(ids, begins.tolist(), counts.tolist(), strict=True):
                    for piece, start in enumerate(range(0, size + 1, limit)):
                        length = min(limit, size + 1 - start)
                        at = 4 * (begin + start)
                        made.append(
                            (doc, piece, start, length, data[at : at + 4 * length], part, places[length])
                        )
                        places[length] += 1
                columns = list(zip(*made, strict=True)) or [()] * 7
                types = [
                    id_type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "place"],
                )

    return written(rows.mapInArrow(run, schema), "packing-pieces", compression="zstd")


@dataclass
class Slots:
    """Where pieces go, by length and rank among all pieces of that length."""

    keys: np.ndarray
    ranks: np.ndarray
    sequences: np.ndarray
    copies: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, plan: Plan) -> Slots:
        rows, sequence, seen = [], 0, Counter()
        for configuration, count in plan.uses:
            offset = 0
            for length, copies in configuration:
                rows.append((length, seen[length], sequence, copies, offset))
                seen[length] += count * copies
                offset += length * copies
            sequence += count
        table = np.array(sorted(rows), np.int64).reshape(len(rows), 5)
        keys = (table[:, 0] << 44) + table[:, 1]
        return cls(keys, table[:, 1], table[:, 2], table[:, 3], table[:, 4])

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        k = np.searchsorted(self.keys, (length << 44) + rank, side="right") - 1
        copy = rank - self.ranks[k]
        return (
            self.sequences[k] + copy // self.copies[k],
            self.offsets[k] + copy % self.copies[k] * length,
        )


def packed(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; other columns come along."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("pieces"))
    histogram = {
        row["length"]: row["pieces"]
        for row in counts.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()
    }
    slots = pieces.sparkSession.sparkContext.broadcast(Slots.of(solve(histogram, limit)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "part", "length", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("_base")
    )
    ranked = pieces.join(bases, ["part", "length"]).withColumn("_rank", F.col("place") + F.col("_base"))
    ranked = ranked.drop("_base", "part", "place")
    names = [c for c in ranked.columns if c != "_rank"]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            where = slots.value.find(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *(pa.array(x, pa.int64()) for x in where)],
                names=[*names, "sequence_id", "offset"],
            )

    schema = ranked.drop("_rank").schema
    return ranked.mapInArrow(run, schema.add("sequence_id", "long").add("offset", "long"))


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; a group has at most ``limit`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.concat_ws("", F.transform(parts, lambda p: F.hex(p["ids"]))).alias("ids")
    ).select("sequence_id", F.unhex("ids").alias("ids"))


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Pieces of all documents with their ids and places."""
    return packed(tokenized(docs, path, limit), limit)


def digests(pieces: DataFrame) -> DataFrame:
    """``pieces`` with a checksum in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
