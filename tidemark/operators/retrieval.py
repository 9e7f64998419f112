"""Hybrid document retrieval: hashed dense ranking, BM25, rank fusion, freshness.

Ids are bigint; among equal scores the larger id comes first, everywhere.

Ranking every document for every query is a product of the two tables. It is never
materialised: documents stay in their partitions and are scored in blocks against a bounded
batch of queries, and only what can still reach the result leaves a block (see
``hybrid_search``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import exact_round, tokens
from tidemark.operators.inverted_index import (
    BM25_B, BM25_EPSILON, BM25_K1, DIMENSIONS, SCORE_PLACES, shuffle_parts, written,
)
from tidemark.session import cut_lineage

# Fusion constant, freshness rule.
RRF_K = 60
FRESH_MINUTES = 15
FRESH_WEIGHT = 3.0

QUERY_BATCH = 2048  # queries scored per pass over the documents' vectors
QUERY_GROUP = 1 << 16  # queries whose terms are looked up in one pass over the texts
_BLOCK_CELLS = 4_000_000


def bucket(token: Column) -> Column:
    """Hash bucket of a token: the first byte of its md5."""
    return F.conv(F.substring(F.md5(token), 1, 2), 16, 10).cast("int")


def hash_embed(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sparse L2-normalised bag of hashed words: (key, bucket, weight)."""
    counts = (
        exploded(docs, [key], tokens(F.col(text)))
        .groupBy(key, bucket(F.col("token")).alias("bucket"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    # A window partition is one document's buckets: 256 rows at most.
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("weight"))


def top_k_per_query(
    scored: DataFrame, k: int, score: str = "score", query: str = "query_id", doc: str = "doc_id"
) -> DataFrame:
    """The k best documents of each query with their 0-based rank.

    ``row_number() ≤ k`` keeps at most k rows per query in each task before the shuffle.
    """
    order = Window.partitionBy(query).orderBy(F.desc(score), F.desc(doc))
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank") - 1)
    )


def exploded(docs: DataFrame, key: list[str | Column], words: Column) -> DataFrame:
    """One row per word. The outer form keeps Spark from testing the array before the explode,
    which would run the tokeniser twice (and ahead of a repartition); its null row of an empty
    text is dropped afterwards."""
    return docs.select(*key, F.explode_outer(words).alias("token")).where("token is not null")


# --- Corpus statistics --------------------------------------------------------------------

_IN_WORD = np.array([chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" for b in range(256)])


def words_of(lowered: pa.StringArray) -> pa.ListArray:
    """The words of lower-cased texts, cut out of their bytes: those that ``scalars.tokens`` finds.
    A null text has none."""
    lowered = lowered.cast(pa.string()).fill_null("")
    if not len(lowered):
        return pa.array([], pa.list_(pa.string()))
    cuts = np.frombuffer(lowered.buffers()[1], np.int32)[lowered.offset :][: len(lowered) + 1].astype(np.int64)
    text = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    cuts -= cuts[0]
    inside = _IN_WORD[text]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = cuts[:-1][cuts[:-1] < cuts[1:]]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    held = text[inside]
    offsets = np.append((np.cumsum(inside) - 1)[starts], len(held)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(held))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, cuts), pa.int32()), words)


_STATISTICS = "token string, df long, texts long, words long"
_HELD_WORDS = 1 << 21  # that a task holds before it counts them


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (token, df), and rows without a token for documents, texts and words."""
    held: list[pa.ListArray] = []
    size = 0

    def count() -> pa.RecordBatch:
        words, codes, row = _encoded(pa.concat_arrays(held))
        width = max(len(words), 1)
        pairs = np.sort(row * width + codes)  # of documents and words
        df = np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]] % width, minlength=len(words))
        nothing = pa.nulls(len(words), pa.int64())
        return pa.RecordBatch.from_arrays(
            [words, pa.array(df, pa.int64()), nothing, nothing], names=["token", "df", "texts", "words"]
        )

    for batch in batches:
        lowered = batch.column(0)
        lists = words_of(lowered)
        words = len(lists.flatten())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None], pa.string()),
                *(pa.array([n], pa.int64()) for n in (len(lowered), len(lowered) - lowered.null_count, words)),
            ],
            names=["token", "df", "texts", "words"],
        )
        held.append(lists)
        size += words
        if size >= _HELD_WORDS:
            yield count()
            held, size = [], 0
    if held:
        yield count()


def _encoded(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the place among them of each word, its list)."""
    flat = lists.flatten().dictionary_encode()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return (
        flat.dictionary,
        flat.indices.to_numpy(zero_copy_only=False).astype(np.int64),
        np.repeat(np.arange(len(lists)), sizes),
    )


def term_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, float]:
    """(per-term idf, mean length), from one pass over the texts. Runs its jobs.

    A term found in more than half of the documents takes a quarter of the mean idf.
    """
    sums = [F.sum(c).alias(c) for c in ("df", "texts", "words")]
    counted = docs.select(F.lower(F.col(text))).mapInArrow(_document_frequency, _STATISTICS)
    counted = written(counted.groupBy("token").agg(*sums), "term-statistics")
    corpus = counted.where("token IS NULL").first()
    size, mean_length = (corpus["df"], corpus["words"] / max(corpus["texts"], 1)) if corpus else (0, 0.0)
    n, df = F.lit(size), F.col("df")
    raw = F.log(n - df + 0.5) - F.log(df + 0.5)
    idf = counted.where("token IS NOT NULL").select("token", raw.alias("raw"))
    mean_idf = idf.agg(F.avg("raw")).first()[0]
    common = F.lit(BM25_EPSILON) * F.lit(mean_idf).cast("double")
    return idf.select("token", F.when(F.col("raw") < 0, common).otherwise(F.col("raw")).alias("idf")), mean_length


def rrf(rankings: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of rows (query_id, doc_id, rank) from any number of rankings."""
    return rankings.groupBy("query_id", "doc_id").agg(
        F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))).alias("score")
    )


def freshness(score: Column, recency_minutes: Column) -> Column:
    """Recent documents weigh three times; unknown age counts as old."""
    fresh = F.coalesce(recency_minutes.cast("double"), F.lit(1e9)) <= FRESH_MINUTES
    return F.when(fresh, score * F.lit(FRESH_WEIGHT)).otherwise(score)


# --- Block scoring ------------------------------------------------------------------------

_VECTOR = "doc_id long, recency double, length int, buckets binary, bucket_n binary, terms binary, tf binary"


def _binary(row: np.ndarray, values: np.ndarray, rows: int) -> pa.BinaryArray:
    """The bytes of each row's values; ``row`` is in order."""
    offsets = (np.searchsorted(row, np.arange(rows + 1)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )


def _flat(column: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values of a column of such bytes."""
    cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    values = np.frombuffer(data.tobytes(), kind)
    return np.repeat(np.arange(len(column)), np.diff(cuts) // values.itemsize), values


def _to_vectors(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.string())
        for batch in batches:
            lists = words_of(batch.column(2))
            words, codes, row = _encoded(lists)
            n = len(lists)
            buckets = np.array([md5(w.encode()).digest()[0] for w in words.to_pylist()], dtype=np.int64)
            hashed = np.bincount(row * DIMENSIONS + buckets[codes], minlength=n * DIMENSIONS)
            cell = np.flatnonzero(hashed)
            place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
            term = place.astype(np.int64)[codes]
            width = max(len(known), 1)
            found, tf = np.unique((row * width + term)[term >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), lists.value_lengths(),
                    _binary(cell // DIMENSIONS, (cell % DIMENSIONS).astype(np.uint8), n),
                    _binary(cell // DIMENSIONS, hashed[cell].astype(np.int32), n),
                    _binary(found // width, (found % width).astype(np.int32), n),
                    _binary(found // width, tf.astype(np.int32), n),
                ],
                names=[field.split()[0] for field in _VECTOR.split(", ")],
            )

    return run


class DocumentBlock:
    """Documents of a task, larger ids first, as arrays."""

    def __init__(self, table: pa.Table, mean_length: float) -> None:
        def column(name: str) -> pa.Array:
            return table.column(name).combine_chunks()

        self.ids = column("doc_id").to_numpy(zero_copy_only=False)
        self.ages = column("recency").to_numpy(zero_copy_only=False)
        row, bucket = _flat(column("buckets"), np.uint8)
        n = _flat(column("bucket_n"), np.int32)[1].astype(np.float64)
        self.hashed = np.zeros((len(self.ids), DIMENSIONS), np.float64)
        self.hashed[row, bucket] = n
        self.heaviest = self.hashed.sum(axis=1).max(initial=0)
        self.inverse = _inverse(np.bincount(row, weights=n * n, minlength=len(self.ids)))
        self.narrow = self.hashed.astype(np.float32)
        row, term = _flat(column("terms"), np.int32)
        tf = _flat(column("tf"), np.int32)[1].astype(np.float64)
        lengths = column("length").to_numpy(zero_copy_only=False)
        relative = lengths / mean_length if mean_length else np.zeros(len(lengths))
        gain = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * relative[row]))
        order = np.argsort(term, kind="stable")
        self.row, self.gain = row[order], gain[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.cuts = np.append(first, len(order))

    def dense(self, asked: QueryChunk) -> np.ndarray:
        """Cosine of every query with every document; 0 for empty vectors. Sums of products of
        counts are whole numbers, exact in the narrow type below 2^24."""
        if self.heaviest * asked.hashed.max(initial=0) < 1 << 24:
            score = (asked.narrow @ self.narrow.T).astype(np.float64)
        else:
            score = asked.hashed @ self.hashed.T
        score *= self.inverse
        score *= asked.inverse[:, None]
        return score

    def sparse(self, asked: QueryChunk) -> np.ndarray:
        """BM25 of every query with every document. A term of many of both is a column of a
        product, another is added where it occurs."""
        score = np.zeros((len(asked.ids), len(self.ids)))
        wide = []
        _, own, other = np.intersect1d(self.terms, asked.terms, assume_unique=True, return_indices=True)
        for t, u in zip(own.tolist(), other.tolist(), strict=True):
            at, of = slice(self.cuts[t], self.cuts[t + 1]), slice(asked.cuts[u], asked.cuts[u + 1])
            rows, queries = self.row[at], asked.query[of]
            if len(rows) * len(queries) * _WIDE > score.size:
                wide.append((at, of))
            else:
                score[queries[:, None], rows] += asked.weight[of][:, None] * self.gain[at]
        if wide:
            left, right = np.zeros((len(asked.ids), len(wide))), np.zeros((len(wide), len(self.ids)))
            for k, (at, of) in enumerate(wide):
                left[asked.query[of], k] = asked.weight[of]
                right[k, self.row[at]] = self.gain[at]
            score += left @ right
        return score


_WIDE = 50


def _inverse(squares: np.ndarray) -> np.ndarray:
    return np.divide(1.0, np.sqrt(squares), out=np.zeros(len(squares)), where=squares > 0)


@dataclass
class QueryChunk:
    """Queries from the place ``first`` of a batch on; their terms are places in the vocabulary."""

    first: int
    ids: np.ndarray
    hashed: np.ndarray
    narrow: np.ndarray
    inverse: np.ndarray
    terms: np.ndarray
    cuts: np.ndarray
    query: np.ndarray
    weight: np.ndarray


_CHUNK = 512  # queries scored at once


def query_chunk(first: int, rows: list, position: dict[str, int], idf: np.ndarray) -> QueryChunk:
    hashed = np.zeros((len(rows), DIMENSIONS))
    said: list[tuple[int, int, float]] = []
    for q, row in enumerate(rows):
        for word, times in Counter(row["tokens"] or ()).items():
            hashed[q, md5(word.encode()).digest()[0]] += times
            if (at := position.get(word)) is not None:
                said.append((at, q, times * idf[at]))
    said.sort()
    term, query = (np.array([s[i] for s in said], dtype=np.int64) for i in range(2))
    terms, cuts = np.unique(term, return_index=True)
    return QueryChunk(
        first, np.array([r["query_id"] for r in rows], dtype=np.int64), hashed, hashed.astype(np.float32),
        _inverse((hashed * hashed).sum(axis=1)), terms, np.append(cuts, len(said)), query,
        np.array([s[2] for s in said], dtype=float),
    )


def _blocks(batches: Iterator[pa.RecordBatch], mean_length: float) -> Iterator[DocumentBlock]:
    step = max(1, _BLOCK_CELLS // _CHUNK)
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= step:
            table = pa.Table.from_batches(held)
            whole = size - size % step
            for start in range(0, whole, step):
                yield DocumentBlock(table.slice(start, step), mean_length)
            rest = table.slice(whole).combine_chunks()
            held, size = rest.to_batches(), size - whole
    if size:
        yield DocumentBlock(pa.Table.from_batches(held), mean_length)


_HALF = 0.5 * 10.0**-SCORE_PLACES  # of the last place of a score
_LEADERS = (
    "query_id long, query int, ranking int, place array<long>, doc_id array<long>, recency array<double>, "
    "dense array<double>, sparse array<double>"
)
_CANDIDATE = "query_id bigint, doc_id bigint, recency double, dense double, sparse double"
_COUNTS = "query_id bigint, doc_id bigint, dense_rank bigint, sparse_rank bigint"


def candidate_depth(k: int) -> int:
    """How deep both rankings must be read for the fused top k to be exact.

    The k-th best scores at least 1/(60+k−1): the k leaders of either ranking do. A document
    below depth M in both scores at most 3·2/(60+M). Equal at M = 6·(60+k−1) − 60.
    """
    return int(2 * FRESH_WEIGHT) * (RRF_K + k - 1) - RRF_K


def _leading(values: np.ndarray, depth: int) -> np.ndarray:
    """Marks the ``depth`` largest values of each row, earlier ones first among equals."""
    if values.shape[1] <= depth:
        return values > -np.inf
    limit = np.partition(values, -depth, axis=1)[:, -depth][:, None]
    kept = values > limit
    ties = (values == limit) & (limit > -np.inf)
    need = (depth - kept.sum(axis=1))[:, None]
    return kept | (ties & (np.cumsum(ties, axis=1) <= need))


class Leaders:
    """The ``depth`` best documents seen of each query by one score, with the other score. Documents
    come with larger ids first, so an earlier one precedes a later one of equal score."""

    def __init__(self, queries: int, depth: int) -> None:
        self.depth, self.room = depth, 2 * depth
        self.size = np.zeros(queries, np.int64)
        self.floor = np.full(queries, -np.inf)
        self.key = np.full((queries, self.room), -np.inf)
        self.other, self.age = np.zeros((2, queries, self.room))
        self.place = np.zeros((queries, self.room), np.int64)
        self.doc = np.zeros((queries, self.room), np.int64)

    def add(self, first: int, score: np.ndarray, other: np.ndarray, block: DocumentBlock, seen: int) -> None:
        part = slice(first, first + len(score))
        found = score > (self.floor[part] + _HALF)[:, None]
        count = np.count_nonzero(found, axis=1)
        if (many := np.flatnonzero(count > self.depth)).size:
            rounded = np.where(found[many], np.round(score[many], SCORE_PLACES), -np.inf)
            found[many] = _leading(rounded, self.depth)
            count[many] = np.count_nonzero(found[many], axis=1)
        query, doc = np.nonzero(found)
        if not len(query):
            return
        self._reduce(first + np.flatnonzero(self.size[part] + count > self.room))
        at = first + query, (self.size[first + query] + np.arange(len(query)) - (np.cumsum(count) - count)[query])
        self.key[at] = np.round(score[query, doc], SCORE_PLACES)
        self.other[at] = np.round(other[query, doc], SCORE_PLACES)
        self.place[at], self.doc[at], self.age[at] = seen + doc, block.ids[doc], block.ages[doc]
        self.size[part] += count

    def _reduce(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        kept = _leading(self.key[rows], self.depth)
        count = np.count_nonzero(kept, axis=1)
        row, column = np.nonzero(kept)
        at = rows[row], np.arange(len(row)) - (np.cumsum(count) - count)[row]
        for held in (self.other, self.age, self.place, self.doc):
            held[at] = held[rows[row], column]
        key = self.key[rows[row], column]
        self.key[rows] = -np.inf
        self.key[at] = key
        self.size[rows] = count
        full = count == self.depth
        self.floor[rows[full]] = self.key[rows[full], : self.depth].min(axis=1)

    def rows(self, ids: np.ndarray, ranking: int) -> Iterator[pa.RecordBatch]:
        self._reduce(np.arange(len(ids)))
        scores = (self.key, self.other) if ranking == 0 else (self.other, self.key)
        for start in range(0, len(ids), 64):
            part = slice(start, start + 64)
            own = np.arange(self.room) < self.size[part][:, None]
            offsets = pa.array(np.append(0, np.cumsum(self.size[part])), pa.int32())
            lists = (
                pa.ListArray.from_arrays(offsets, pa.array(x[part][own]))
                for x in (self.place, self.doc, self.age, *scores)
            )
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[part]), pa.array(np.arange(start, start + n), pa.int32()),
                    pa.array(np.full(n, ranking), pa.int32()), *lists,
                ],
                names=["query_id", "query", "ranking", "place", "doc_id", "recency", "dense", "sparse"],
            )


def _leaders(shared, depth: int, mean_length: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = shared.value
        ids = np.concatenate([c.ids for c in chunks])
        held = [Leaders(len(ids), depth) for _ in range(2)]
        seen = TaskContext.get().partitionId() << 40
        for block in _blocks(batches, mean_length):
            for chunk in chunks:
                dense, sparse = block.dense(chunk), block.sparse(chunk)
                held[0].add(chunk.first, dense, sparse, block, seen)
                held[1].add(chunk.first, sparse, dense, block, seen)
            seen += len(block.ids)
        for ranking in range(2):
            yield from held[ranking].rows(ids, ranking)

    return run


def _places(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """0-based place of each by (score, id), both descending."""
    place = np.empty(len(ids), np.int64)
    place[np.lexsort((-ids, -score))] = np.arange(len(ids))
    return place


def _chosen(k: int, depth: int):
    """The leaders of all tasks' leaders; of those, the documents that can be among the fused top k.

    A place within ``depth`` is the rank itself, any other rank is ``depth`` at least, which bounds
    a document's fused score from both sides. What stays below the k-th best lower bound is left
    out. Where ids repeat, ranks are not places, and all leaders stay.
    """

    def choose(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        query, ranking, place, ids, ages, dense, sparse = (np.concatenate(x) for x in zip(*rows, strict=True))
        ranks = []
        for r, score in enumerate((dense, sparse)):
            own = np.flatnonzero(ranking == r)
            rank = np.full(len(ids), depth)
            rank[own] = np.minimum(_places(score[own], ids[own]), depth)
            ranks.append(rank)
        leads = np.flatnonzero((ranks[0] < depth) | (ranks[1] < depth))
        by_row = np.stack([query[leads], place[leads]])
        _, one, row = np.unique(by_row, axis=1, return_index=True, return_inverse=True)
        best = np.full((2, len(one)), depth)
        for r in range(2):
            np.minimum.at(best[r], row.ravel(), ranks[r][leads])
        one = leads[one]
        if len(one) > k and len(np.unique(ids[one])) == len(one) and len(np.unique(query)) == 1:
            weight = np.where(ages[one] <= FRESH_MINUTES, FRESH_WEIGHT, 1.0)
            shares = 1.0 / (RRF_K + best)
            most = weight * shares.sum(axis=0)
            least = weight * np.where(best < depth, shares, 0.0).sum(axis=0)
            one = one[most >= np.sort(least)[-k] * (1 - 1e-9)]
        return ids[one], ages[one], dense[one], sparse[one]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []

        def flush() -> pa.RecordBatch:
            columns = choose(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(columns[0]), current), pa.int64()), *map(pa.array, columns)],
                names=["query_id", "doc_id", "recency", "dense", "sparse"],
            )

        for batch in batches:
            heads = zip(*(batch.column(c).to_pylist() for c in ("query_id", "query", "ranking")), strict=True)
            lists = [batch.column(c) for c in ("place", "doc_id", "recency", "dense", "sparse")]
            cuts = lists[0].offsets.to_numpy()
            flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
            for k_row, (query_id, query, ranking) in enumerate(heads):
                if query_id != current and rows:
                    yield flush()
                    rows = []
                current = query_id
                own = slice(cuts[k_row], cuts[k_row + 1])
                n = cuts[k_row + 1] - cuts[k_row]
                rows.append((np.full(n, query), np.full(n, ranking), *(x[own] for x in flat)))
        if rows:
            yield flush()

    return run


def _ahead(scores: np.ndarray, before: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """How many documents come before each candidate: of equal score, those among the first
    ``before``, whose ids are larger."""
    if len(candidates) > 64:
        ordered = np.sort(scores)
        ahead = len(scores) - np.searchsorted(ordered, candidates + _HALF, "right")
        tied = np.searchsorted(ordered, candidates - _HALF, "right") < len(scores) - ahead
        for j in np.flatnonzero(tied):
            first = scores[: before[j]]
            ahead[j] += np.count_nonzero((first > candidates[j] - _HALF) & (first <= candidates[j] + _HALF))
        return ahead
    return np.array([
        np.count_nonzero(scores[:n] > c - _HALF) + np.count_nonzero(scores[n:] > c + _HALF)
        for n, c in zip(before.tolist(), candidates.tolist(), strict=True)
    ])


def _rank_counts(shared, mean_length: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, candidates = shared.value
        totals = [np.zeros((2, len(c[0])), dtype=np.int64) for c in candidates]
        for block in _blocks(batches, mean_length):
            smaller_first = -block.ids
            for chunk in chunks:
                scores = block.dense(chunk), block.sparse(chunk)
                for q in range(len(chunk.ids)):
                    ids, *own = candidates[chunk.first + q]
                    if len(ids):
                        before = np.searchsorted(smaller_first, -ids)
                        for r in range(2):
                            totals[chunk.first + q][r] += _ahead(scores[r][q], before, own[r])
        sizes = [len(c[0]) for c in candidates]
        ids = np.concatenate([c.ids for c in chunks])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(ids, sizes), pa.int64()),
                pa.array(np.concatenate([c[0] for c in candidates]), pa.int64()),
                *(pa.array(x, pa.int64()) for x in np.concatenate(totals, axis=1)),
            ],
            names=["query_id", "doc_id", "dense_rank", "sparse_rank"],
        )

    return run


def _query_groups(queries: DataFrame, text: str) -> Iterator[list]:
    """The queries in groups of bounded size; only one group is on the driver at a time."""
    total = queries.count()
    parts = max(1, -(-total // (QUERY_GROUP // 2)))
    listed = queries.select("query_id", tokens(F.col(text)).alias("tokens"))
    for part in range(parts):
        rows = listed
        if parts > 1:
            rows = listed.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        group = rows.orderBy("query_id").collect()
        if group:
            yield group


def _batches(group: list) -> Iterator[list]:
    """Runs of at most about ``QUERY_BATCH`` queries; those of one id stay together."""
    start = 0
    for end in range(1, len(group) + 1):
        if end == len(group) or (
            end - start >= QUERY_BATCH and group[end]["query_id"] != group[end - 1]["query_id"]
        ):
            yield group[start:end]
            start = end


def candidate_ranks(docs: DataFrame, queries: DataFrame, k: int, text: str = "text") -> DataFrame:
    """(query_id, doc_id, recency, dense_rank, sparse_rank): the exact 0-based ranks, among all
    documents, of those that can be among the fused top k (see ``candidate_depth``).

    docs(doc_id, text, recency_minutes), queries(query_id, text). The texts are read twice, once for
    the statistics and once for their vectors, which are written. Per batch of queries:

    1. each task scores its documents, a block against a chunk of queries at a time, and keeps its
       leaders of both rankings, as deep as ``candidate_depth`` proves necessary;
    2. of the global leaders those that the bounds of ``_chosen`` leave become the candidates, and a
       second pass counts how many documents come before each of them in each ranking.

    Nothing but leaders and counts is shuffled. Runs its jobs before returning.
    """
    spark = docs.sparkSession
    idf, mean_length = term_statistics(docs, text)
    depth = candidate_depth(k)
    results = []
    for group in _query_groups(queries, text):
        words = sorted({w for row in group for w in row["tokens"] or ()})
        known = spark.createDataFrame([(w,) for w in words] or [("",)], "token string")
        terms = idf.join(F.broadcast(known), "token").orderBy("token").toPandas()
        position = {t: i for i, t in enumerate(terms["token"])}
        vocabulary = spark.sparkContext.broadcast(list(position))
        vectors = written(
            docs.select("doc_id", F.col("recency_minutes").cast("double"), F.lower(F.col(text)))
            .mapInArrow(_to_vectors(vocabulary), _VECTOR), "document-vectors"
        )
        # Few long tasks: what a task emits depends on the queries, not on its share of documents.
        blocks = vectors.coalesce(spark.sparkContext.defaultParallelism)
        blocks = blocks.sortWithinPartitions(F.desc("doc_id"))
        for batch in _batches(group):
            chunks = [
                query_chunk(start, batch[start : start + _CHUNK], position, terms["idf"].to_numpy(dtype=float))
                for start in range(0, len(batch), _CHUNK)
            ]
            shared = spark.sparkContext.broadcast(chunks)
            leaders = blocks.mapInArrow(_leaders(shared, depth, mean_length), _LEADERS)
            chosen = cut_lineage(
                leaders.repartition(shuffle_parts(docs), "query_id").sortWithinPartitions("query_id")
                .mapInArrow(_chosen(k, depth), _CANDIDATE)
            )
            # At most QUERY_BATCH · 2 · depth rows.
            grouped = dict(list(chosen.toPandas().groupby("query_id")))
            columns = ("doc_id", "dense", "sparse")
            empty = (np.empty(0, np.int64), np.empty(0), np.empty(0))
            candidates = [
                tuple(grouped[q][c].to_numpy() for c in columns) if q in grouped else empty
                for q in np.concatenate([c.ids for c in chunks]).tolist()
            ]
            counts = _rank_counts(spark.sparkContext.broadcast((chunks, candidates)), mean_length)
            ranked = (
                blocks.mapInArrow(counts, _COUNTS)
                .groupBy("query_id", "doc_id")
                .agg(F.sum("dense_rank").alias("dense_rank"), F.sum("sparse_rank").alias("sparse_rank"))
            )
            ages = chosen.select("query_id", "doc_id", "recency")
            results.append(cut_lineage(ranked.join(ages, ["query_id", "doc_id"])))
    if not results:
        return spark.createDataFrame([], f"{_COUNTS}, recency double")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def hybrid_search(
    docs: DataFrame, queries: DataFrame, k: int = 3, text: str = "text"
) -> DataFrame:
    """Top k documents per query by freshness-weighted rank fusion of dense and BM25 ranks.

    docs(doc_id, text, recency_minutes), queries(query_id, text) → (query_id, doc_id,
    retrieval_score, position), exactly as if every document had been ranked.
    """
    ranked = candidate_ranks(docs, queries, k, text)
    fused = F.lit(1.0) / (F.lit(RRF_K) + F.col("dense_rank")) + F.lit(1.0) / (
        F.lit(RRF_K) + F.col("sparse_rank")
    )
    scored = ranked.withColumn("score", freshness(fused, F.col("recency")))
    return top_k_per_query(scored, k).select(
        "query_id",
        "doc_id",
        exact_round(F.col("score"), 5).alias("retrieval_score"),
        F.col("rank").alias("position"),
    )
