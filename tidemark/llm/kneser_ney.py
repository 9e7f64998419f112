"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by workers.

Level 1 holds the hashes of the training words, level k the n-grams of k words: the key of an
n-gram is (index of its first k - 1 words in level k - 1, index of its last k - 1 words) as one
number of 64 bits, so keys are exact and every level is a set of sorted arrays. A level on more than
2^32 distinct n-grams of the level below would not fit that number: training raises there instead
of merging n-grams. A level is cut into shards by hash; n-grams of one context share a shard unless the context is so frequent that it is split.

Counting: tasks count their own n-grams in sorted arrays and send one compressed array per shard;
the shard's task merges them and writes its arrays to the shared folder. Going down from the
longest n-grams, each shard then sends what the level below needs: in how many n-grams a shorter
one is the end (its Kneser-Ney count; an n-gram that starts with the begin mark ends none and keeps
its own count), and totals and numbers of counts 1, 2 and 3 or more of each
context. Tables list the files of the tasks that succeeded, so a retried task is harmless.

Scoring: a slice of texts looks up its distinct keys in the mapped arrays, level by level.

    p(w | context) = (count - discount) / total + weight(context) * p(w | shorter context)

ending in 1 / (V + 1) for words never seen. A text starts after a begin mark (a context, never
predicted) and ends with an end token. The model grows with the corpus; nothing of it passes
through the driver but a row per shard. Higher orders than the default of 3 work and need
more disk.

Defined results: a null or empty text is its end token alone; without training texts every token
is unknown and has probability 1 (V = 0); repeated rows count and are scored each; other columns
pass through, the text only on demand; columns named like a result are replaced.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from tidemark.llm.batches import annotate, bounded_batches, slices, texts_of, written
from tidemark.llm.planes import from_planes, from_steps, to_planes, to_steps
from tidemark.llm.warc import file_system
from tidemark.llm.words import SPACED_LOWER, Words, mix
from tidemark.session import working_path

ORDER = 3
LARGEST_BELOW = 1 << 32  # distinct n-grams of a level whose pairs still fit 64 bits
HELD_KEYS = 1 << 22  # n-grams that a task holds before it sends them on
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
ADDED = 0.1  # of the base model


# --- arrays in files and in shuffled rows -------------------------------------------------


def save(folder: str, arrays: list[np.ndarray]) -> str:
    """One new file with all arrays one after the other; returns its name."""
    store, top = file_system(folder)
    store.create_dir(top, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{top}/{name}", compression=None) as stream:
        for array in arrays:
            stream.write(np.ascontiguousarray(array).tobytes())
    return name


_LOCAL_COPIES: dict[str, str] = {}


def local_path(folder: str, name: str) -> str:
    """Path of a shared file that this machine can map. A store that is no file system is copied
    once per worker to the folder that Spark gives it for files, and again if that is lost."""
    from pyarrow.fs import LocalFileSystem
    from pyspark import SparkFiles

    store, top = file_system(folder)
    if isinstance(store, LocalFileSystem):
        return f"{top}/{name}"
    key = f"{folder}/{name}"
    if key not in _LOCAL_COPIES:
        target = os.path.join(SparkFiles.getRootDirectory(), f"{uuid.uuid4().hex}-{name}")
        with store.open_input_stream(f"{top}/{name}") as source, open(target, "wb") as copy:
            while block := source.read(1 << 24):
                copy.write(block)
        _LOCAL_COPIES[key] = target
    return _LOCAL_COPIES[key]


def mapped(folder: str, name: str, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    """Arrays of a file by (type, length), mapped into memory."""
    path, at, made = local_path(folder, name), 0, []
    for kind, n in kinds:
        # as plain arrays: every slice of a memmap object costs Python calls
        made.append(
            np.memmap(path, kind, "r", offset=at, shape=(n,)).view(np.ndarray) if n else np.empty(0, kind)
        )
        at += np.dtype(kind).itemsize * n
    return made


# --- levels -------------------------------------------------------------------------------


@dataclass
class Level:
    """Shards of one level: files of keys and counts, and of the statistics added later.

    Counts and statistics are bytes; those of 255 and more are listed apart with their positions.
    """

    files: list[str | None]
    sizes: list[int]
    large: list[int]
    hot: np.ndarray  # indices in the level below whose n-grams are spread over all shards
    below: int = 0  # entries of the level below
    statistics: list[str | None] = field(default_factory=list)
    counts_of_counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    total: int = 0
    #: Indices of entries so frequent that, as contexts, they are hot in the level above.
    frequent: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    #: How many of each shard's statistics are 255 and more, by column.
    large_statistics: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        return shard_of(keys, self.below, self.hot, len(self.sizes))

    def discounts(self) -> np.ndarray:
        """Discounts of counts 0, 1, 2 and 3 or more. Where a count of counts is missing, all are
        that of absolute discounting."""
        n1, n2, n3, n4 = self.counts_of_counts
        plain = n1 / (n1 + 2 * n2) if n1 else 0.5
        if min(n1, n2, n3, n4) == 0:
            return np.array([0.0, *[min(max(plain, 0.05), 0.95)] * 3])
        made = [1 - 2 * plain * n2 / n1, 2 - 3 * plain * n3 / n2, 3 - 4 * plain * n4 / n3]
        return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(made, 1))])


def shard_of(keys: np.ndarray, below: int, hot: np.ndarray, shards: int) -> np.ndarray:
    """By the context of an n-gram, or by all of it if the context is hot."""
    if not below:
        return (mix(keys) % np.uint64(shards)).astype(np.int64)
    context = keys // np.uint64(below)
    base = context if not len(hot) else np.where(np.isin(context, hot), keys, context)
    return (mix(base) % np.uint64(shards)).astype(np.int64)


@dataclass
class Counts:
    """Whole numbers as bytes; ``values`` has those of 255 and more, at the positions ``at``."""

    small: np.ndarray
    at: np.ndarray
    values: np.ndarray

    @staticmethod
    def kinds(n: int, large: int) -> list[tuple[str, int]]:
        return [("u1", n), ("u8", large), ("u8", large)]

    @classmethod
    def of(cls, counts: np.ndarray) -> Counts:
        large = np.flatnonzero(counts >= 255)
        small = np.minimum(counts, 255).astype("u1")
        return cls(small, large.astype("u8"), counts[large].astype("u8"))

    def arrays(self) -> list[np.ndarray]:
        return [self.small, self.at, self.values]

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        made = self.small[places].astype(np.int64)
        if len(self.at):
            large = np.flatnonzero(made == 255)
            made[large] = self.values[np.searchsorted(self.at, places[large].astype(np.uint64))]
        return made

    def all(self) -> np.ndarray:
        return self[np.arange(len(self.small))]


class Shard:
    def __init__(self, folder: str, level: Level, number: int):
        n, large = level.sizes[number], level.large[number]
        name = level.files[number]
        kinds = [("u8", n), *Counts.kinds(n, large)]
        if name is None:
            self.keys, *counts = (np.empty(0, k) for k, _ in kinds)
        else:
            self.keys, *counts = mapped(folder, name, kinds)
        self.counts = Counts(*counts)
        self.statistics = None
        if level.statistics and level.statistics[number] is not None:
            kinds = [k for m in level.large_statistics[number] for k in Counts.kinds(n, m)]
            held = mapped(folder, level.statistics[number], kinds)
            self.statistics = [Counts(*held[k : k + 3]) for k in range(0, len(held), 3)]


@dataclass
class Model:
    """Levels 1 to ``order`` with their folder; workers open shards when they need them."""

    folder: str
    levels: list[Level]
    tokens: int = 0

    def __post_init__(self):
        self._open: dict[tuple[int, int], Shard] = {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def shard(self, level: int, number: int) -> Shard:
        key = (level, number)
        if key not in self._open:
            self._open[key] = Shard(self.folder, self.levels[level - 1], number)
        return self._open[key]

    @property
    def vocabulary(self) -> int:
        """Distinct training tokens; the begin mark is an entry, but no token."""
        return max(0, self.levels[0].size - 1)

    def find(self, level: int, keys: np.ndarray, statistics: bool = False):
        """(index or -1, count, statistics or None) of sorted distinct keys."""
        held = self.levels[level - 1]
        index, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        more = np.zeros((5, len(keys)), np.int64) if statistics else None
        for number, own in _split(held.shard_of(keys), len(held.sizes)):
            one = self.shard(level, number)
            if not len(one.keys):
                continue
            place = np.searchsorted(one.keys, keys[own])
            place[place == len(one.keys)] = 0
            hit = one.keys[place] == keys[own]
            own, place = own[hit], place[hit]
            index[own] = held.offsets[number] + place
            count[own] = one.counts[place]
            if statistics and one.statistics is not None:
                more[:, own] = [column[place] for column in one.statistics]
        return index, count, more


def token_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of begin mark, words and end token of each text, and the number of them."""
    words = Words(texts, SPACED_LOWER)
    counts = words.counts + 2
    ends = np.cumsum(counts)
    flat = np.empty(int(counts.sum()), np.uint64)
    inner = np.ones(len(flat), bool)
    inner[ends - 1], inner[ends - counts] = False, False
    flat[ends - counts], flat[ends - 1] = BEGIN, END
    flat[inner] = words.hashes
    return flat, counts


def gram_keys(model: Model, level: int, index: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys of the n-grams of ``level`` ending at each place from the indices one level below;
    ``known`` marks those whose parts are known. Places before ``level`` - 1 have none."""
    below = np.uint64(model.levels[level - 2].size)
    left = np.append(-1, index[:-1])
    known = (place >= level - 1) & (left >= 0) & (index >= 0)
    key = np.where(known, left, 0).astype(np.uint64) * below + np.where(known, index, 0).astype(
        np.uint64
    )
    return key, known


def looked_up(model: Model, level: int, keys: np.ndarray, known: np.ndarray, statistics=False):
    """``find`` for keys that repeat, at the known places; nothing elsewhere."""
    index, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    more = np.zeros((5, len(keys)), np.int64) if statistics else None
    distinct, back = np.unique(keys[known], return_inverse=True)
    found = model.find(level, distinct, statistics)
    index[known], count[known] = found[0][back], found[1][back]
    if statistics:
        more[:, known] = found[2][:, back]
    return index, count, more


def places_of(counts: np.ndarray) -> np.ndarray:
    starts = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(starts, counts)


# --- training -----------------------------------------------------------------------------

_PART = "shard int, kind int, a binary, b binary, c binary, d binary, e binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list("skabcde")
    )


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _split(shard: np.ndarray, shards: int):
    """(shard, its places in order); numbers of 16 bits are sorted by radix."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    cuts = np.append(0, np.cumsum(np.bincount(shard, minlength=shards)))
    for number in range(shards):
        if cuts[number] < cuts[number + 1]:
            yield number, order[cuts[number] : cuts[number + 1]]


def count_level(
    texts: DataFrame, model: Model, level: int, shards: int, hot: np.ndarray
) -> Level:
    """Counts the n-grams of one level and writes its shards."""
    below = model.levels[-1].size if level > 1 else 0
    if below > LARGEST_BELOW:
        raise ValueError(f"{below} distinct n-grams of {level - 1} words: pairs do not fit 64 bits")
    known_model = texts.sparkSession.sparkContext.broadcast(model)
    folder = model.folder

    def emit(batches):
        keys, counts, held = [], [], 0

        def flush():
            all_keys, all_counts = _summed(np.concatenate(keys), np.concatenate(counts))
            rows = []
            for number, own in _split(shard_of(all_keys, below, hot, shards), shards):
                rows.append(
                    (number, 0, to_steps(all_keys[own]), to_planes(all_counts[own]), *[None] * 3)
                )
            return _rows(rows)

        for whole in batches:
            for batch in slices(whole, "text"):
                flat, sizes = token_hashes(texts_of(batch, "text"))
                if level == 1:
                    own = flat
                else:
                    place = places_of(sizes)
                    index = looked_up(known_model.value, 1, flat, np.ones(len(flat), bool))[0]
                    for k in range(2, level):
                        key, known = gram_keys(known_model.value, k, index, place)
                        index = looked_up(known_model.value, k, key, known)[0]
                    key, known = gram_keys(known_model.value, level, index, place)
                    own = key[known]
                distinct, count = np.unique(own, return_counts=True)
                keys.append(distinct)
                counts.append(count)
                held += len(distinct)
                if held >= HELD_KEYS:
                    yield flush()
                    keys, counts, held = [], [], 0
        if held:
            yield flush()

    def merge(batches):
        for number, rows in _by_shard(batches):
            keys, counts = _summed(
                np.concatenate([from_steps(r[2]) for r in rows]),
                np.concatenate([from_planes(r[3]).astype(np.int64) for r in rows]),
            )
            held = Counts.of(counts)
            name = save(folder, [keys.astype("u8"), *held.arrays()])
            frequent = counts >= max(2, counts.sum() // shards)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int32()),
                    pa.array([name]),
                    pa.array([[len(keys), len(held.at), int(counts.sum())]], pa.list_(pa.int64())),
                    pa.array([[int((counts == k).sum()) for k in (1, 2, 3, 4)]], pa.list_(pa.int64())),
                    pa.array([np.flatnonzero(frequent).tolist()], pa.list_(pa.int64())),
                    pa.array([counts[frequent].tolist()], pa.list_(pa.int64())),
                ],
                names=["shard", "file", "sizes", "counted", "places", "counts"],
            )

    made = texts.mapInArrow(emit, _PART).repartition(shards, "shard").sortWithinPartitions("shard")
    table = written(
        made.mapInArrow(
            merge,
            "shard int, file string, sizes array<long>, counted array<long>, places array<long>, "
            "counts array<long>",
        ),
        f"lm-level-{level}",
    )
    files, sizes, large = [None] * shards, [0] * shards, [0] * shards
    total, counted, frequent = 0, np.zeros(4, np.int64), []
    for row in table.collect():
        files[row["shard"]] = row["file"]
        sizes[row["shard"]], large[row["shard"]] = row["sizes"][:2]
        total += row["sizes"][2]
        counted += row["counted"]
        frequent += [(row["shard"], p, c) for p, c in zip(row["places"], row["counts"], strict=True)]
    made_level = Level(files, sizes, large, hot, below, [], counted.tolist(), total)
    made_level.frequent = np.array(
        sorted(made_level.offsets[s] + p for s, p, c in frequent if c * shards >= total), np.uint64
    )
    return made_level


def _by_shard(batches):
    """(shard, its rows); rows come sorted by shard."""
    current, held = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if row[0] != current and held:
                yield current, held
                held = []
            current = row[0]
            held.append(row)
    if held:
        yield current, held


def descend(spark: SparkSession, model: Model, level: int) -> None:
    """Sends from the shards of ``level`` what the level below needs, and writes it there."""
    upper, lower = model.levels[level - 1], model.levels[level - 2]
    shards, folder = len(upper.sizes), model.folder
    held = spark.sparkContext.broadcast(model)
    top = level == len(model.levels)

    def emit(batches):
        for batch in batches:
            for number in batch.column("id").to_pylist():
                shard = held.value.shard(level, number)
                if not len(shard.keys):
                    continue
                keys = np.asarray(shard.keys)
                counts = (shard.counts if top else shard.statistics[0]).all()
                below = np.uint64(lower.size)
                rows = []
                ends, number_of = np.unique(keys % below, return_counts=True)
                for target, own in _split(_shard_by_index(lower, ends), shards):
                    rows.append((target, 1, to_steps(ends[own]), to_planes(number_of[own]), *[None] * 3))
                context, back = np.unique(keys // below, return_inverse=True)
                n = len(context)
                numbers = [
                    np.bincount(back, counts, n).astype(np.int64),
                    np.bincount(back, counts == 1, n).astype(np.int64),
                    np.bincount(back, counts == 2, n).astype(np.int64),
                    np.bincount(back, counts >= 3, n).astype(np.int64),
                ]
                for target, own in _split(_shard_by_index(lower, context), shards):
                    rows.append(
                        (target, 2, to_steps(context[own]), *(to_planes(x[own]) for x in numbers))
                    )
                yield _rows(rows)

    def merge(batches):
        for number, rows in _by_shard(batches):
            n, base = lower.sizes[number], int(lower.offsets[number])
            columns = np.zeros((5, n), np.int64)
            for _, kind, where, *values in rows:
                at = from_steps(where).astype(np.int64) - base
                if kind == 1:
                    columns[0][at] += from_planes(values[0]).astype(np.int64)
                else:
                    for column, value in zip(columns[1:], values, strict=True):
                        column[at] += from_planes(value).astype(np.int64)
            if level > 2:
                # Only what starts with the begin mark has nothing before it.
                first = columns[0] == 0
                columns[0][first] = held.value.shard(level - 1, number).counts[np.flatnonzero(first)]
            counts = [Counts.of(c) for c in columns]
            name = save(folder, [a for c in counts for a in c.arrays()])
            counted = [int((columns[0] == k).sum()) for k in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int32()), pa.array([name]),
                    pa.array([[*counted, int(columns[0].sum())]], pa.list_(pa.int64())),
                    pa.array([[len(c.at) for c in counts]], pa.list_(pa.int64())),
                ],
                names=["shard", "file", "counted", "large"],
            )

    made = spark.range(0, shards, 1, shards).mapInArrow(emit, _PART)
    made = made.repartition(shards, "shard").sortWithinPartitions("shard")
    table = written(
        made.mapInArrow(merge, "shard int, file string, counted array<long>, large array<long>"),
        f"lm-below-{level}",
    )
    lower.statistics, lower.large_statistics = [None] * shards, [[]] * shards
    counted = np.zeros(5, np.int64)
    for row in table.collect():
        lower.statistics[row["shard"]] = row["file"]
        lower.large_statistics[row["shard"]] = row["large"]
        counted += row["counted"]
    lower.counts_of_counts, lower.total = counted[:4].tolist(), int(counted[4])


def _shard_by_index(level: Level, index: np.ndarray) -> np.ndarray:
    return np.searchsorted(level.offsets, index.astype(np.int64), side="right") - 1


def train(texts: DataFrame, order: int = ORDER, shards: int | None = None) -> Model:
    """``texts``: column ``text``, read once per level."""
    spark = texts.sparkSession
    bounded_batches(spark)
    texts = texts.select("text")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(working_path(spark, "language-model"), [])
    hot = np.empty(0, np.uint64)
    for level in range(1, order + 1):
        made = count_level(texts, model, level, shards, hot)
        hot = made.frequent
        model = Model(model.folder, [*model.levels, made], model.tokens)
        if level == 1:
            # every text has one begin mark and one end token
            begins = model.find(1, np.array([BEGIN]))[1].sum()
            model.tokens = made.total - int(begins)
    for level in range(order, 1, -1):
        descend(spark, model, level)
        model = Model(model.folder, model.levels, model.tokens)
    return model


# --- scoring ------------------------------------------------------------------------------


def interpolated(model: Model, flat: np.ndarray, place: np.ndarray):
    """(probability, training count) of every token given those before it; the begin marks get
    probability 1."""
    distinct, back = np.unique(flat, return_inverse=True)
    index, count, more = model.find(1, distinct, statistics=True)
    lowest = model.levels[0]
    discount = lowest.discounts()
    kind = lambda c: np.minimum(c, 3)
    ends = more[0]
    counted = np.array(lowest.counts_of_counts[:2])
    rest = lowest_weight(lowest, discount, counted)
    uniform = 1.0 / (model.vocabulary + 1)
    chance = np.maximum(ends - discount[kind(ends)], 0) / max(lowest.total, 1) + rest * uniform
    chance, index, count, more = chance[back], index[back], count[back], more[:, back]
    for level in range(2, len(model.levels) + 1):
        held = model.levels[level - 1]
        top = level == len(model.levels)
        key, known = gram_keys(model, level, index, place)
        next_index, raw, upper = looked_up(model, level, key, known, statistics=not top)
        seen = raw if top else upper[0]
        context = np.concatenate([np.zeros((5, 1), np.int64), more[:, :-1]], axis=1)
        usable = (place >= level - 1) & (context[1] > 0)
        discount = held.discounts()
        total = np.maximum(context[1], 1)
        weight = (discount[1] * context[2] + discount[2] * context[3] + discount[3] * context[4]) / total
        longer = np.maximum(seen - discount[kind(seen)], 0) / total + weight * chance
        chance = np.where(usable, longer, chance)
        index, more = next_index, upper
    return np.where(place == 0, 1.0, chance), count


def lowest_weight(level: Level, discount: np.ndarray, counted: np.ndarray) -> float:
    """What the discounts of single words leave for the uniform distribution."""
    if not level.total:
        return 1.0
    words = max(0, level.size - 1)
    more = words - int(counted.sum())
    return float(discount[1] * counted[0] + discount[2] * counted[1] + discount[3] * more) / level.total


FIELDS = [
    StructField("n_tokens", LongType()),
    StructField("n_known", LongType()),
    StructField("train_tokens", LongType()),
    StructField("base_score", DoubleType()),
    StructField("score", DoubleType()),
    StructField("perplexity", DoubleType()),
]


def score(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """``docs`` with token numbers, the base and the model's log10 probability and perplexity."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        own = held.value

        def judge(texts):
            flat, counts = token_hashes(texts)
            place = places_of(counts)
            chance, seen = interpolated(own, flat, place)
            token = place > 0
            owner = np.repeat(np.arange(len(counts)), counts)[token]
            n = counts - 1
            base = np.log10((seen[token] + ADDED) / (own.tokens + ADDED * (own.vocabulary + 1)))
            add = lambda values: np.bincount(owner, values, minlength=len(counts))
            total = add(np.log10(chance[token]))
            return [
                n, add(seen[token] > 0).astype(np.int64), np.full(len(n), own.tokens), add(base), total,
                10.0 ** (-total / n),
            ]

        return judge

    return annotate(docs, kernel, FIELDS, keep_text=keep_text)
