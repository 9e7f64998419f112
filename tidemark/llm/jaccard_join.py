"""N-gram Jaccard join as a blocked sparse product, and the groups that its links form.

The incidence matrix has a row per document and a column per shingle (hashed). Documents with
equal sets are one class. Two sets of sizes a and b reach the threshold t only if they differ in
at most ``(1 - t) / (1 + t) * (a + b)`` shingles; sizes within a factor of t are necessary.

1. Column blocks. Classes of similar size share a division of the columns into more blocks than
   they may differ in, so a linking pair agrees on some whole block (pigeonhole). Agreement on
   a block makes a candidate, if the blocks after it may belong to a linking pair too: counted
   from some block on which they agree, the first l blocks of a linking pair hold at most l - 1 of
   its differences, for every l (cycle lemma). A block's content is hashed into one number, the
   ``CHAIN`` blocks from it on into 64 parities, which differ in no more places than the blocks do.
   Every task first links its own rows of equal number and parities and sends one of them on; of a
   number with very many parities it links all rows and sends one, so what a number shared by a
   third of all rows costs is bounded per task. What a task finds it sends as one link from each
   row to the smallest id that it reaches there, so links grow with rows and not with pairs.
2. Candidate groups. The candidates' connected groups hold every linking pair.
3. Row blocks. A group of at most ``BLOCK_ROWS`` is one block. The rows of a larger one are
   compared with one pivot of the group, in a join, and cut into blocks by size; only pairs of
   blocks whose sizes are compatible and that hold a row not linked to the pivot are multiplied.
   A product accumulates overlaps over chunks of columns, drops pairs below the overlap that
   their sizes demand, and emits a spanning forest of its links, never all pairs.
4. The links' connected groups are the result.

Every link between different sets is found, as each step only discards pairs that cannot link;
links within a group that is already connected need no row of their own.

Defined results: texts without words, null or empty, have an empty set and link with nothing;
rows that repeat an id are one document with the sets of all its rows; a null id has no group
(null); columns named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from tidemark.llm.batches import annotate, bounded_batches, slices, texts_of, written
from tidemark.llm.planes import from_planes, from_steps, to_planes, to_steps
from tidemark.llm.words import SPACED_LOWER, Words, mix, shingle_sets

SHINGLE = 4
PERCENT = 85
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20  # fewer rows to a block where sets are larger than this over BLOCK_ROWS
BLOCK_COLUMNS = 4096
SIZE_STEP = 1.25  # of the size classes that share a division of the columns
HOT_SHINGLES = 1 << 17  # most frequent shingles left out of the column blocks; any set is exact
HOT_DOCUMENTS = 48  # from so many documents on
MAX_TASK_ROWS = 1 << 21  # links, or half the shingles, that a task holds before it reduces them
HELD_BLOCKS = 1 << 20  # block numbers with their parities, likewise
BUCKETS = 4  # of block numbers to a partition; one is held at a time
CHAIN = 8  # column blocks whose parities go with a block number
SENT_PARITIES = 256  # of one number that a task sends on; beyond, its rows are linked untested
TESTED_PARITIES = 2048  # of one number that are tested against each other; beyond, the same
UNTESTED = np.uint64((1 << 64) - 1)  # parities of a row that stands for rows linked untested


@dataclass(frozen=True)
class Rule:
    shingle: int = SHINGLE
    percent: int = PERCENT

    def links(self, overlap, a, b):
        """100 * intersection >= percent * union, in whole numbers."""
        return (100 + self.percent) * overlap >= self.percent * (a + b)

    def difference(self, size: int) -> int:
        """Most shingles by which two linking sets of at most ``size`` each can differ."""
        return (100 - self.percent) * 2 * size // (100 + self.percent)

    def size_class(self, size: np.ndarray) -> np.ndarray:
        return np.floor(np.log(size) / np.log(SIZE_STEP) + 1e-9).astype(np.int64)

    def largest(self, size_class: int) -> int:
        return int(np.ceil(SIZE_STEP ** (size_class + 1) * (1 + 1e-9)))

    def blocks(self, size_class: int) -> tuple[int, int]:
        """(blocks, most differing blocks) of a size class."""
        most = self.difference(self.largest(size_class))
        return (most + most // 16 + 3 if most else 1), most

    def classes_of(self, size: int) -> list[int]:
        """The own size class, and the next where a linking larger set may be in it."""
        own = int(self.size_class(np.array([size]))[0])
        reach = int(self.size_class(np.array([max(size, 100 * size // self.percent)]))[0])
        return list(range(own, reach + 1))


def _divided(shingles: np.ndarray, blocks: int, salt: int):
    """A number for the content of each column block, the parities of the blocks from it on, and
    which blocks the set touches."""
    block = (((mix(shingles) >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    scrambled = mix(~shingles)[order]
    sums = np.append(np.uint64(0), np.cumsum(scrambled, dtype=np.uint64))
    cuts = np.searchsorted(block[order], np.arange(blocks + 1))
    content = sums[cuts[1:]] - sums[cuts[:-1]]
    place = np.arange(blocks, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(salt)
    bits = np.uint64(1) << (scrambled >> np.uint64(58))
    before = np.append(np.uint64(0), np.bitwise_xor.accumulate(bits))[cuts]
    chain = min(CHAIN, blocks)
    around = np.concatenate([before, before[-1] ^ before[1 : chain + 1]])  # on from the first block
    parities = around[chain : chain + blocks] ^ around[:blocks]
    return mix(content + mix(place)), parities, cuts[1:] > cuts[:-1]


def numbered_blocks(shingles: np.ndarray, cold: np.ndarray, rule: Rule):
    """Numbers and parities of the column blocks of a set, for each of its size classes; ``cold``
    marks the shingles that are not hot.

    Two linking sets agree on a block that both touch with cold shingles if one of them touches
    more of those than they may differ in. A set that does not is divided once more with all its
    shingles; if it still touches too few blocks, its empty ones count too. Of two sets that do
    not find each other one way both go on to the next.

    Where they must agree, one of them counts more blocks than they differ in. With one for each
    counted block less its differences, the sum around the ring of blocks is positive, so from some
    block on all partial sums are: that block is counted and without difference, and the first l
    blocks from it on differ in at most l - 1 shingles.
    """
    made, parities = [], []
    for size_class in rule.classes_of(len(shingles)):
        blocks, most = rule.blocks(size_class)
        numbers, chains, touched = _divided(shingles[cold], blocks, 2 * size_class + 1)
        made.append(numbers[touched])
        parities.append(chains[touched])
        if touched.sum() <= most:
            numbers, chains, touched = _divided(shingles, blocks, 2 * size_class + 2)
            counted = touched if touched.sum() > most else np.ones(blocks, bool)
            made.append(numbers[counted])
            parities.append(chains[counted])
    return np.concatenate(made), np.concatenate(parities)


def block_numbers(shingles: np.ndarray, cold: np.ndarray, rule: Rule) -> np.ndarray:
    return numbered_blocks(shingles, cold, rule)[0]


def hot_shingles(docs: DataFrame, rule: Rule, least=HOT_DOCUMENTS, most=HOT_SHINGLES) -> np.ndarray:
    """Sorted hashes of the shingles in the most documents, ``most`` at most. Tasks report what
    they see at least twice, so a shingle counts if it is frequent in some tasks."""
    bounded_batches(docs.sparkSession)

    def emit(batches):
        held, size = [], 0

        def flush():
            shingles, count = np.unique(np.concatenate(held), return_counts=True)
            twice = count > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(shingles[twice].view(np.int64)), pa.array(count[twice])], ["shingle", "n"]
            )

        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(Words(texts_of(batch, "text"), SPACED_LOWER), rule.shingle)
                held += sets
                size += sum(map(len, sets))
                if size > 2 * MAX_TASK_ROWS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    counts = docs.select("text").mapInArrow(emit, "shingle long, n long")
    counts = counts.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "shingle").limit(most).select("shingle").toArrow()
    return np.sort(found.column("shingle").to_numpy().astype(np.int64).view(np.uint64))


def is_cold(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.ones(len(shingles), bool)
    place = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
    return hot[place] != shingles


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def shingled(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, digest) of every row; the digest of an empty set is null."""

    def kernel():
        def judge(texts):
            sets = shingle_sets(Words(texts, SPACED_LOWER), rule.shingle)
            return [[len(s) for s in sets], [set_digest(s) if len(s) else None for s in sets]]

        return judge

    fields = [StructField("n_shingles", LongType()), StructField("digest", BinaryType())]
    return annotate(docs.select("doc_id", "text"), kernel, fields, keep_text=False)


def _stars(numbers: np.ndarray, parities: np.ndarray, ids: np.ndarray, most: int):
    """Links of rows with equal number and parities, as stars of their smallest id, and one row of
    each. A number with more than ``most`` parities, or with a row that stands for such ones, keeps
    one row; all its rows are linked to that."""
    order = np.lexsort((ids, parities, numbers))
    numbers, parities, ids = numbers[order], parities[order], ids[order]
    new_number = np.append(True, numbers[1:] != numbers[:-1])[: len(ids)]
    first = new_number.copy()
    first[1:] |= parities[1:] != parities[:-1]
    pairs = _linked_to(first, ids)
    numbers, parities, ids, new_number = (x[first] for x in (numbers, parities, ids, new_number))
    run = np.cumsum(new_number) - 1
    untested = np.bincount(run) > most
    untested[run[parities == UNTESTED]] = True
    untested = untested[run]
    pairs = np.concatenate([pairs, _linked_to(new_number[untested], ids[untested])])
    kept = ~untested | new_number
    parities = np.where(untested, UNTESTED, parities)
    return np.unique(pairs, axis=0), numbers[kept], parities[kept], ids[kept]


def _linked_to(first: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(first id, other id) within runs that begin at ``first``."""
    lead = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))]
    return np.stack([lead, ids], axis=1)[~first & (lead != ids)]


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's part, after links (a, b) have joined parts."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def _to_smallest(pairs: np.ndarray) -> np.ndarray:
    """One link from the smallest id that it reaches to every other id of ``pairs``: they connect
    what ``pairs`` connect, and are fewer than the ids."""
    ids, place = np.unique(pairs, return_inverse=True)
    a, b = place.reshape(-1, 2).T
    return _stars_to(ids, _joined(np.arange(len(ids)), a, b))


def _stars_to(ids: np.ndarray, root: np.ndarray) -> np.ndarray:
    pairs = np.stack([ids[root], ids], axis=1)[root != np.arange(len(ids))]
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def _candidates(numbers: np.ndarray, parities: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Links that connect the rows of equal number whose parities may be those of a linking pair:
    to the smallest id reached, fewer than the ids."""
    pairs, numbers, parities, ids = _stars(numbers, parities, ids, TESTED_PARITIES)
    nodes, place = np.unique(np.concatenate([pairs.ravel(), ids]), return_inverse=True)
    (a, b), place = place[: pairs.size].reshape(-1, 2).T, place[pairs.size :]
    root = _joined(np.arange(len(nodes)), a, b)
    at, step = np.arange(len(ids)), 0
    while len(at):
        step += 1
        at = at[at + step < len(ids)]
        at = at[numbers[at] == numbers[at + step]]
        near = at[np.bitwise_count(parities[at] ^ parities[at + step]) < CHAIN]
        root = _joined(root, place[near], place[near + step])
    return _stars_to(nodes, root)


_BLOB = "bucket int, numbers binary, ids binary, parities binary"


def _pair_rows(pairs: np.ndarray, buckets: int):
    """(bucket, ids, ids) of links, by their first id."""
    bucket = (mix(pairs[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.unique(bucket).tolist():
        own = order[cuts[k] : cuts[k + 1]]
        yield k, to_planes(pairs[own, 0]), to_planes(pairs[own, 1]), None


def _blobs(numbers: np.ndarray, parities: np.ndarray, ids: np.ndarray, buckets: int):
    """One row per bucket of numbers, and one per bucket -1 - k of links."""
    pairs, numbers, parities, ids = _stars(numbers, parities, ids, SENT_PARITIES)
    bucket = (numbers >> np.uint64(24)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for k in range(buckets):
        own = order[cuts[k] : cuts[k + 1]]
        if len(own):
            rows.append((k, to_steps(numbers[own]), to_planes(ids[own]), parities[own].tobytes()))
    rows += [(-1 - k, *arrays) for k, *arrays in _pair_rows(_to_smallest(pairs), buckets)]
    return _as_batch(rows)


def _rows_of(batch: pa.RecordBatch):
    for k in range(batch.num_rows):
        yield [column[k].as_py() for column in batch.columns]


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
        names=["bucket", "numbers", "ids", "parities"],
    )


def candidate_links(docs: DataFrame, rule: Rule, partitions: int) -> DataFrame:
    """(a, b) links that connect the documents that agree on a column block and may on those after it."""
    buckets = BUCKETS * partitions
    bounded_batches(docs.sparkSession)
    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, rule))

    def emit(batches):
        numbers, parities, ids, held = [], [], [], 0

        def flush():
            return _blobs(*(np.concatenate(x) for x in (numbers, parities, ids)), buckets)

        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(Words(texts_of(batch, "text"), SPACED_LOWER), rule.shingle)
                for doc, shingles in zip(batch.column("doc_id").to_pylist(), sets, strict=True):
                    if len(shingles):
                        own, chains = numbered_blocks(shingles, is_cold(shingles, hot.value), rule)
                        numbers.append(own)
                        parities.append(chains)
                        ids.append(np.full(len(own), doc, np.int64))
                        held += len(own)
                if held >= HELD_BLOCKS:
                    yield flush()
                    numbers, parities, ids, held = [], [], [], 0
        if held:
            yield flush()

    def merge(batches):
        """Links of equal numbers, to the smallest id reached in a partition, bucketed for the last
        step; links that tasks have found themselves go on as they are."""
        current, held = None, []
        found = [np.empty((0, 2), np.int64)]

        def meet():
            found.append(_candidates(*(np.concatenate(x) for x in zip(*held, strict=True))))

        for batch in batches:
            for bucket, left, right, chains in _rows_of(batch):
                if bucket < 0:
                    yield _as_batch([(-1 - bucket, left, right, None)])
                    continue
                if bucket != current and held:
                    meet()
                    held = []
                current = bucket
                held.append(
                    (from_steps(left), np.frombuffer(chains, np.uint64), from_planes(right).view(np.int64))
                )
        if held:
            meet()
        pairs = _to_smallest(np.concatenate(found))
        if len(pairs):
            yield _as_batch(list(_pair_rows(pairs, buckets)))

    def distinct(batches):
        """What the links of a bucket connect, one link an id at most: they all meet here."""
        held = [np.empty((0, 2), np.int64)]
        for batch in batches:
            for _, left, right, _ in _rows_of(batch):
                pair = [from_planes(x).view(np.int64) for x in (left, right)]
                held.append(np.stack(pair, axis=1))
                if sum(map(len, held)) > MAX_TASK_ROWS:
                    held = [_to_smallest(np.concatenate(held))]
        pairs = _to_smallest(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    sent = rows.mapInArrow(emit, _BLOB).repartition(partitions, "bucket")
    merged = sent.sortWithinPartitions("bucket").mapInArrow(merge, _BLOB)
    return merged.repartition(partitions, "bucket").mapInArrow(distinct, "a long, b long")


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected(links: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): the smallest node that it reaches.

    Alternates linking all neighbours of a node to its smallest (large star) and the smaller
    neighbours to the smallest (small star) until nothing changes, which takes a logarithmic
    number of rounds; each is written to the shared folder. Minima are partial aggregates, so a
    node with a third of all links is no hot task in them.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a != b").distinct(), name
    )
    mark = _mark(edges)
    while True:
        near = both(edges)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a != b")
            .distinct()
        )
        edges = written(small, name)
        seen = _mark(edges)
        if seen == mark:
            break
        mark = seen
    # now every edge points to its root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs: a sparse product accumulated over chunks of columns.
    Columns that only one row has add nothing and are left out."""
    rows = len(left) + len(right)
    owner = np.repeat(np.arange(rows), [len(s) for s in (*left, *right)])
    flat = np.concatenate([*left, *right])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, BLOCK_COLUMNS):
        a, b = np.searchsorted(column, [start, start + BLOCK_COLUMNS])
        part = np.zeros((rows, min(BLOCK_COLUMNS, width - start)), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        total += part[: len(left)] @ part[len(left) :].T
    return total


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Indices of links that join parts of 0..n-1 not joined by earlier ones."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    chosen = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[x] = y
            chosen.append(k)
    return chosen


def _tile_links(rows, rule: Rule):
    """Links of one pair of row blocks; ``rows`` holds (side, doc, shingles)."""
    left = [r for r in rows if r[0] == 0]
    right = [r for r in rows if r[0] == 1] or left
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids = np.array([r[1] for r in left], np.int64), np.array([r[1] for r in right], np.int64)
    size = [np.array([len(r[2]) for r in side]) for side in (left, right)]
    overlap = overlaps([r[2] for r in left], [r[2] for r in right]).astype(np.int64)
    x, y = np.nonzero(rule.links(overlap, size[0][:, None], size[1][None, :]))
    nodes, place = np.unique(np.concatenate(ids), return_inverse=True)
    a, b = place[: len(left)][x], place[len(left) :][y]
    chosen = spanning(a, b, len(nodes))
    return nodes[a[chosen]], nodes[b[chosen]]


def _size_class(rule: Rule):
    """Sizes that can link lie in one class or in neighbouring ones."""
    width = float(np.log(100 / rule.percent))
    return F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(width) + F.lit(1e-9)).cast("int")


def compared_with_pivot(sets: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, root, near): whether a row links to its group's root."""
    pivots = sets.where("doc_id = root").select("root", F.col("shingles").alias("pivot"))

    def compare(batches):
        for batch in batches:
            near = []
            columns = (batch.column(c).to_pylist() for c in ("shingles", "pivot"))
            for own, pivot in zip(*columns, strict=True):
                a, b = np.frombuffer(own, np.uint64), np.frombuffer(pivot, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                near.append(bool(rule.links(common, len(a), len(b))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "root", "z")), pa.array(near)],
                names=["doc_id", "root", "z", "near"],
            )

    pairs = sets.join(pivots, "root").mapInArrow(
        compare, "doc_id long, root long, z int, near boolean"
    )
    return pairs.groupBy("doc_id", "root", "z").agg(F.max("near").alias("near"))


def tiles_of(compared: DataFrame, rule: Rule, block_rows: int) -> DataFrame:
    """(doc_id, root, tile): the pairs of row blocks that a row of a large group is part of.

    Blocks are rows of one size class, either linked to the pivot or apart from it. A tile is two
    blocks of compatible size, at least one of them apart; the tile names the block apart first.
    """
    width = float(np.log(100 / rule.percent))
    limit = F.greatest(
        F.lit(1),
        F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_SHINGLES) / F.exp((F.col("z") + 1) * F.lit(width)))),
    )
    sizes = compared.groupBy("root", "z").agg(
        F.ceil(F.count_if(~F.col("near")) / limit).cast("int").alias("apart"),
        F.ceil(F.count_if("near") / limit).cast("int").alias("linked"),
    )
    # the numbers of blocks of the class itself and of the classes before and after it
    around = sizes.withColumn("shift", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    around = around.groupBy("root", (F.col("z") + F.col("shift")).alias("z")).agg(
        *(
            F.coalesce(F.max(F.when(F.col("shift") == -step, F.col(kind))), F.lit(0)).alias(
                f"{kind}{name}"
            )
            for step, name in ((-1, "_before"), (0, "_own"), (1, "_after"))
            for kind in ("apart", "linked")
        )
    )
    own = F.when(F.col("near"), F.col("linked_own")).otherwise(F.col("apart_own"))
    dealt = compared.join(around, ["root", "z"]).withColumn(
        "block", F.pmod(F.xxhash64("doc_id"), F.greatest(own, F.lit(1))).cast("int")
    )
    z, block = F.col("z"), F.col("block")

    def tile(kind: int, z_left, left, z_right, right, side):
        return F.struct(
            F.lit(kind).alias("kind"), z_left.alias("zl"), left.alias("i"), z_right.alias("zr"),
            right.alias("j"), side.alias("side"),
        )

    def each(count: str, made):
        """One tile per block of a neighbouring class."""
        return F.transform(
            F.filter(F.sequence(F.lit(0), F.greatest(F.col(count), F.lit(1)) - 1), lambda k: k < F.col(count)),
            made,
        )

    zero, one = F.lit(0), F.lit(1)
    apart = F.concat(
        each("apart_own", lambda k: tile(
            0, z, F.least(block, k), z, F.greatest(block, k), F.when(k >= block, 0).otherwise(1)
        )),
        each("apart_after", lambda k: tile(0, z, block, z + 1, k, zero)),
        each("apart_before", lambda k: tile(0, z - 1, k, z, block, one)),
        each("linked_own", lambda k: tile(1, z, block, z, k, zero)),
        each("linked_after", lambda k: tile(1, z, block, z + 1, k, zero)),
        each("linked_before", lambda k: tile(1, z, block, z - 1, k, zero)),
    )
    linked = F.concat(
        each("apart_own", lambda k: tile(1, z, k, z, block, one)),
        each("apart_after", lambda k: tile(1, z + 1, k, z, block, one)),
        each("apart_before", lambda k: tile(1, z - 1, k, z, block, one)),
    )
    return dealt.select(
        "doc_id", "root", F.explode(F.when(F.col("near"), linked).otherwise(apart)).alias("tile")
    )


_TILE = ["root", "kind", "zl", "i", "zr", "j"]


def multiplied(placed: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): a spanning forest of the links of each tile; ``placed`` has the tile's columns,
    ``side``, ``doc_id`` and ``shingles``."""
    spark = placed.sparkSession
    width = len(_TILE)

    def multiply(batches):
        key, rows = None, []

        def flush():
            a, b = _tile_links(rows, rule)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if row[:width] != key:
                    if rows:
                        yield flush()
                    key, rows = row[:width], []
                rows.append((*row[width:-1], np.frombuffer(row[-1], np.uint64)))
        if rows:
            yield flush()

    return (
        placed.select(*_TILE, "side", "doc_id", "shingles")
        .repartition(_partitions(spark), *_TILE)
        .sortWithinPartitions(*_TILE)
        .mapInArrow(multiply, "a long, b long")
    )


def verified_links(docs: DataFrame, groups: DataFrame, rule: Rule, block_rows: int) -> DataFrame:
    """(a, b) links that connect what the threshold connects within each candidate group.

    ``groups``: (doc_id, root, z, large), one row per size class of a document that has a candidate; ``large``
    marks groups of more rows than a block.
    """
    # the condition holds for all; it lets Spark put a Bloom filter of the ids before the texts'
    # shuffle, as it does by itself for scans of 10 GB
    docs.sparkSession.conf.set(
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "32MB"
    )
    arrays = annotate(
        docs.join(groups.where("z >= 0"), "doc_id"),
        lambda: lambda texts: [
            [s.tobytes() for s in shingle_sets(Words(texts, SPACED_LOWER), rule.shingle)]
        ],
        [StructField("shingles", BinaryType())],
        keep_text=False,
    )
    sets = written(arrays.select("doc_id", "root", "z", "large", "shingles"), "jaccard-sets")
    nothing = [F.lit(0).alias(c) for c in (*_TILE[1:], "side")]
    small = sets.where("NOT large").select("root", *nothing, "doc_id", "shingles")
    large = sets.where("large")
    compared = written(compared_with_pivot(large, rule), "jaccard-pivots")
    with_pivot = compared.where("near AND doc_id != root").select(
        F.col("root").alias("a"), F.col("doc_id").alias("b")
    )
    tiles = tiles_of(compared, rule, block_rows)
    placed = large.join(tiles, ["doc_id", "root"]).select(
        "root", *(f"tile.{c}" for c in (*_TILE[1:], "side")), "doc_id", "shingles"
    )
    return with_pivot.unionByName(multiplied(small.unionByName(placed), rule))


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def jaccard_groups(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest id that links reach."""
    spark, rule = docs.sparkSession, Rule(shingle, percent)
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = written(shingled(docs, rule), "jaccard-classes")
    # copies: rows with one set are linked to the smallest id among them
    usable = sets.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    copies = usable.join(classes.where("rows > 1").select("digest", "least"), "digest")
    copies = written(
        copies.where("doc_id != least").select("doc_id", "least").distinct(), "jaccard-copies"
    )
    candidates = candidate_links(docs, rule, _partitions(spark))
    # candidates among representatives only; an id of several texts stays, as no other has them all
    texts = usable.groupBy("doc_id").agg(F.min("digest").alias("_low"), F.max("digest").alias("_high"))
    several = texts.where("_low != _high").select("doc_id")
    replaced = copies.join(several, "doc_id", "left_anti")
    of_class = lambda e, c: e.join(
        replaced.select(F.col("doc_id").alias(c), F.col("least").alias("_to")), c, "left"
    ).withColumn(c, F.coalesce("_to", c)).drop("_to")
    candidates = of_class(of_class(candidates, "a"), "b").where("a != b")
    groups = connected(candidates, "jaccard-candidates").select(F.col("node").alias("doc_id"), "root")
    # a row per size class that an id has texts of; each of its texts is compared in all of them
    sized = usable.withColumn("z", _size_class(rule)).groupBy("doc_id", "z").agg(
        F.max("n_shingles").alias("n_shingles")
    )
    groups = groups.join(sized, "doc_id")
    rows = groups.groupBy("root").agg(
        (
            (F.count("*") > block_rows) | (F.sum("n_shingles") > 4 * BLOCK_SHINGLES)
        ).alias("large")
    )
    groups = written(groups.join(rows, "root").select("doc_id", "root", "z", "large"), "jaccard-groups")
    links = verified_links(docs, groups, rule, block_rows)
    links = links.unionByName(copies.select(F.col("least").alias("a"), F.col("doc_id").alias("b")))
    roots = connected(links, "jaccard-links")
    return sets.join(roots, sets["doc_id"] == roots["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest id; rows without an id stay.

    Only the ids to drop meet the texts, in an anti-join that Spark plans by their size. Rows that
    repeat an id are one document: they stay or go together.
    """
    groups = jaccard_groups(docs.select("doc_id", "text"), shingle, percent)
    dropped = groups.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
