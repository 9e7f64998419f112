"""Centroid clustering, periodic runs and shortest-pack-first packing."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import components, documents, near, prose, texts, words
from tidemark.llm import centroids, jaccard_join, kneser_ney, periodic_runs, queries, spf_packing
from tidemark.llm.suffix_tree import Extensions


# ---- near duplicates of ids with several texts ---------------------------------------------


def shingles(text):
    ws = words(text, True)
    return frozenset(tuple(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))) if ws else frozenset()


def test_links_through_any_text_of_a_repeated_id(spark):
    first, second = prose(31, 200), prose(32, 200)
    data = [(1, first), (5, first), (5, second), (9, near(second, 1, 1))]
    found = jaccard_join.jaccard_groups(spark.createDataFrame(data, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(1, 1), (5, 1), (9, 1)}


@pytest.mark.parametrize("block_rows", [3, 1024])
def test_groups_with_many_repeated_ids_match_all_pairs(spark, block_rows):
    rng = random.Random(13)
    bases = [prose(600 + k, rng.choice([12, 80, 300])) for k in range(14)]
    data = []
    for k in range(160):
        doc = rng.randrange(k) if k and rng.random() < 0.2 else k
        base = rng.choice(bases)
        data.append((doc, base if rng.random() < 0.4 else near(base, k, rng.randrange(6))))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    sets: dict = {}
    for doc, text in data:
        sets.setdefault(doc, set()).add(shingles(text))
    expected = components(sets, 85)
    for row in jaccard_join.jaccard_groups(docs, block_rows=block_rows).collect():
        assert row["component_id"] == expected[row["doc_id"]]


# ---- periodic runs ---------------------------------------------------------------------------


def runs_by_hand(ws, min_length=6, min_exponent=4):
    found: dict = {}
    for period in range(1, len(ws) // min_exponent + 1):
        i = 0
        while i + period < len(ws):
            j = i
            while j + period < len(ws) and ws[j] == ws[j + period]:
                j += 1
            length = j - i + period
            if j > i and length >= max(min_length, min_exponent * period):
                found.setdefault((i, length), period)  # a smaller period came first
            i = max(j, i + 1)
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed_by_hand(ws, runs):
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(ws) if k not in gone)


def random_words(rng):
    n, kinds = rng.randrange(40), rng.choice([1, 2, 2, 3])
    ws = [str(rng.randrange(kinds)) for _ in range(n)]
    if ws and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(2, 9)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    return ws


@pytest.mark.parametrize(("min_length", "min_exponent"), [(6, 4), (2, 2), (4, 3)])
def test_runs_of_random_words_match_the_definition(min_length, min_exponent):
    rng = random.Random(min_length)
    kernel = periodic_runs._kernel(min_length, min_exponent)
    for _ in range(400):
        cases = [random_words(rng) for _ in range(rng.randrange(1, 5))]
        counts, runs, collapsed = kernel([" \t".join(ws) or None for ws in cases])
        for ws, n, own, text in zip(cases, counts.tolist(), runs, collapsed, strict=True):
            expected = runs_by_hand(ws, min_length, min_exponent)
            assert n == len(ws)
            assert [tuple(r.values()) for r in own] == expected
            assert text == collapsed_by_hand(ws, expected)


def test_extensions_and_ranks_match_the_definition():
    rng = random.Random(5)
    for _ in range(60):
        letters = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))]
        found = Extensions(letters)
        suffixes = sorted(range(len(letters) + 1), key=lambda k: [*letters[k:], 0])
        assert found.rank[suffixes].tolist() == list(range(len(letters) + 1))
        pairs = [(a, b) for a in range(len(letters)) for b in range(len(letters)) if a != b]
        if pairs:
            a, b = np.array(pairs).T
            expected = [
                next((k for k, (x, y) in enumerate(zip(letters[i:], letters[j:], strict=False)) if x != y),
                     len(letters) - max(i, j))
                for i, j in pairs
            ]
            assert found.common(a, b).tolist() == expected


def tail_by_hand(doc, text):
    ws = words(text)
    if doc is None or not ws:
        return ws
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(ws)
    if h % 10:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]


def test_periodic_runs_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(9)
    data = [(k, t, "en", "c", 1, "x") for k, t in enumerate(texts()) if t is None or len(t) < 9000]
    data += [(500 + k, prose(k, rng.randrange(60)), "en", "c", 1, "x") for k in range(150)]
    data += [(900, "a b\n" * 900 + "c", "en", "c", 1, "x"), (None, "x " * 7, "en", "c", 1, "x"), (900, None) + ("",) * 2 + (1, "")]
    documents(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = Counter()
    for doc, text, *_ in data:
        ws = tail_by_hand(doc, text)
        runs = runs_by_hand(ws)
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        expected[
            doc, len(runs), start, length, period, 1000 * length // period if runs else None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed_by_hand(ws, runs)),
        ] += 1
    found = queries.op12_periodic_runs(spark, str(tmp_path))
    assert Counter(map(tuple, found.collect())) == expected
    assert sum(row[1] > 0 for row in expected) > 10
    assert {kind for _, kind in found.dtypes[1:6]} == {"bigint"}


def test_periodic_runs_keep_columns_and_rows(spark):
    found = periodic_runs.periodic_runs(documents(spark))
    assert found.count() == documents(spark).count()
    assert found.columns.count("n_words") == 1 and "kept" in found.columns and "text" in found.columns
    assert periodic_runs.periodic_runs(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(documents(spark), min_exponent=1)


# ---- centroid clustering -----------------------------------------------------------------------


def clusters_by_hand(rows, k=40, rounds=5, dimensions=64):
    kept = [
        (i, [math.floor(256 * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    named = sorted(((sha(f"2:{i}"), v) for i, v in kept if i is not None))
    values = [v for _, v in named[:k]]

    def assigned():
        return [
            min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(values))
            for _, v in kept
        ]

    for _ in range(rounds):
        where = assigned()
        for n in range(len(values)):
            own = [v for (_, v), (_, at) in zip(kept, where, strict=True) if at == n]
            if own:
                values[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    where = assigned()
    inertia = Counter()
    for distance, n in where:
        inertia[n] += distance
    return Counter(
        (i, n, d, inertia[n], sum(inertia.values()), sha(",".join(map(str, values[n]))))
        for (i, _), (d, n) in zip(kept, where, strict=True)
    )


def vectors():
    rng = random.Random(11)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    rows = [(k, [rng.gauss(m, 0.3) for m in rng.choice(middles)]) for k in range(400)]
    rows += [(k, [float(k % 3)] * 64) for k in range(400, 460)]  # ties and repeated vectors
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (461, None), (462, []), (463, [0.5] * 63)]
    rows += [(464, [None, *[0.1] * 63]), (465, [float("nan")] * 64), (466, [float("inf"), *[0.0] * 63])]
    rows += [(467, [-1e-9] * 64), (468, [1000.0, *[-1000.0] * 63])]
    return rows


SCHEMA = "vec_id long, embedding array<double>, cluster string, label int"


def test_clusters_match_brute_force(spark, tmp_path):
    table = spark.createDataFrame([(*row, "clash", 1) for row in vectors()], SCHEMA)
    table.repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op11_centroid_clustering(spark, str(tmp_path))
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, found.select(names).collect())) == clusters_by_hand(vectors())
    assert [kind for _, kind in found.select(names).dtypes[1:5]] == ["int", "bigint", "bigint", "bigint"]


def test_few_and_no_vectors(spark):
    few = vectors()[:5]
    found = centroids.cluster(spark.createDataFrame([(*row, "", 1) for row in few], SCHEMA))
    assert sorted(r["distance"] for r in found.collect()) == [0] * 5
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    nameless = spark.createDataFrame([(None, [0.0] * 64, "", 1)], SCHEMA)
    assert centroids.cluster(nameless).count() == 0
    with pytest.raises(Exception, match="steps"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, "", 1)], SCHEMA)).count()


def test_search_is_exact_and_measures_few_centroids():
    rng = np.random.default_rng(3)
    for spread in (0, 2, 400):
        values = rng.integers(-300, 300, (40, 64)) + rng.integers(-spread, spread + 1, (40, 1))
        own = values[rng.integers(0, 40, 500)] + rng.integers(-9, 10, (500, 64))
        search = centroids.Centroids(values)
        label, distance = search.nearest(own)
        every = ((own[:, None, :] - values[None]) ** 2).sum(axis=2)
        assert (label == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert search.measured < every.size / 2


# ---- shortest-pack-first packing ------------------------------------------------------------------


def fills_by_hand(histogram, limit):
    packs: list = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            if packs and limit - min(packs) >= length:
                packs[packs.index(min(packs))] += length
            else:
                packs.append(length)
    return sorted(packs)


def test_plans_place_every_token_once_and_pad_nothing():
    rng = random.Random(2)
    for _ in range(400):
        limit = rng.choice([1, 2, 8, 16, 64, 1024])
        histogram = Counter()
        for _ in range(rng.randrange(6)):
            histogram[rng.randrange(1, limit + 1)] += rng.randrange(1, 30)
        packs = spf_packing.shortest_pack_first(histogram, limit)
        fills = [x for p, count in packs.items() for x in [spf_packing.fill_of(p)] * count]
        assert sorted(fills) == fills_by_hand(histogram, limit)
        plan, held = spf_packing.solve(histogram, limit), {}
        for length, count in histogram.items():
            for rank in range(count):
                at = 0
                for first, size, sequence, offset in plan.pieces(length, rank):
                    assert first == at and size > 0
                    at += size
                    held.setdefault(sequence, []).append((offset, size))
                assert at == length
        for parts in held.values():
            end = 0
            for offset, size in sorted(parts):
                assert offset == end
                end += size
            assert end == limit or end & (end - 1) == 0
        tokens = sum(length * count for length, count in histogram.items())
        powers = sum(1 for fill in fills if fill < limit and fill & (fill - 1) == 0)
        assert plan.sequences == len(held) <= tokens // limit + powers + limit.bit_length()


def test_pieces_hold_the_tokens_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    odd = ["it's 'tis, <|endoftext|> ΑΣ. İ 日本。\x1c\x85 x y", "x’s ½ ² ١٢ \U0001f600‍ á"]
    data = [(r["doc_id"], r["text"], "en", "c", 1, "x") for r in documents(spark).collect()]
    data += [(7000 + k, t, "en", "c", 1, "x") for k, t in enumerate(odd)]
    docs = documents(spark, data).repartition(5)
    placed = spf_packing.pack(docs)
    rows = placed.collect()
    pieces: dict = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], bytes(r["ids"])))
    expected: dict = {}
    for doc, text, *_ in data:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        expected.setdefault((doc, len(ids)), Counter())[struct.pack(f"<{len(ids)}I", *ids)] += 1
    assert set(pieces) == set(expected)
    for key, parts in pieces.items():
        if sum(expected[key].values()) == 1:
            assert b"".join(data for *_, data in sorted(parts)) == next(iter(expected[key]))
        else:  # rows that repeat an id and a length
            assert sum(n for _, n, _ in parts) == key[1] * sum(expected[key].values())
    end: Counter = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end[r["sequence_id"]]
        end[r["sequence_id"]] += r["length"]
    assert max(end.values()) <= 1024
    whole = spf_packing.padding(placed).first()
    assert whole["padded"] == 0 and whole["tokens"] == sum(end.values()) and whole["sequences"] == len(end)
    assert len(end) <= sum(end.values()) // 1024 + 12


def test_empty_tables_and_texts_pack(spark):
    assert spf_packing.pack(documents(spark, [])).count() == 0
    assert spf_packing.padding(spf_packing.pack(documents(spark, []))).first()["padded"] == 0
    rows = spf_packing.pack(documents(spark, [(None, None, "en", "c", 1, "x"), (1, "", "en", "c", 1, "x")])).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["ids"])) for r in rows) == [(0, bytes(4)), (1, bytes(4))]


# ---- candidates of the Jaccard join -----------------------------------------------------------


def test_linking_pairs_agree_on_a_block_with_near_parities():
    rng = random.Random(9)
    rule = jaccard_join.Rule(5, 80)
    tested = 0
    for _ in range(400):
        size = rng.choice([1, 3, 8, 30, 100, 700])
        own = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
        drop, add = rng.randrange(1 + size // 5), rng.randrange(1 + size // 5)
        fresh = np.array([rng.getrandbits(64) for _ in range(add)], np.uint64)
        other = np.unique(np.concatenate([own[drop:], fresh]))
        if not rule.links(len(np.intersect1d(own, other)), len(own), len(other)):
            continue
        tested += 1
        hot = np.sort(np.array(rng.sample(own.tolist(), rng.randrange(len(own) + 1)), np.uint64))
        made = [jaccard_join.numbered_blocks(s, jaccard_join.is_cold(s, hot), rule) for s in (own, other)]
        ids = np.repeat([1, 2], [len(numbers) for numbers, _ in made])
        pairs = jaccard_join._candidates(*(np.concatenate(x) for x in zip(*made, strict=True)), ids)
        assert pairs.tolist() == [[1, 2]]
    assert tested > 200


def test_unlike_texts_with_a_common_passage_are_no_candidates(spark):
    passage = prose(77, 40)
    data = [(k, prose(7000 + k, 120) + " " + passage + " " + prose(8000 + k, 120)) for k in range(40)]
    data += [(100, data[0][1] + " more"), (101, data[0][1])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = jaccard_join.candidate_links(docs, jaccard_join.Rule(5, 80), 4).collect()
    assert {tuple(sorted((r["a"], r["b"]))) for r in found} <= {(0, 100), (0, 101), (100, 101)}
    assert found


@pytest.mark.parametrize(("sent", "tested"), [(2, 3), (256, 3), (256, 2048)])
def test_numbers_with_many_parities_keep_all_links(spark, monkeypatch, sent, tested):
    monkeypatch.setattr(jaccard_join, "SENT_PARITIES", sent)
    monkeypatch.setattr(jaccard_join, "TESTED_PARITIES", tested)
    base = prose(55, 150)
    data = [(k, near(base, k, k % 9) if k % 3 else prose(500 + k, 20) + base) for k in range(60)]
    sets = {doc: {shingles(text)} for doc, text in data}
    expected = components(sets, 85)
    found = jaccard_join.jaccard_groups(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == expected


def test_candidates_connect_near_parities_with_fewer_links_than_rows():
    rng = random.Random(21)
    for _ in range(60):
        bases = [rng.getrandbits(64) for _ in range(rng.randrange(1, 5))]
        rows = [(rng.randrange(3), rng.choice(bases), rng.randrange(80)) for _ in range(rng.randrange(1, 120))]
        rows = [(n, p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))), i) for n, p, i in rows]
        numbers, parities, ids = (np.array(x, t) for x, t in zip(zip(*rows), (np.uint64, np.uint64, np.int64)))
        pairs = jaccard_join._candidates(numbers, parities, ids).tolist()
        parent = {i: i for i in ids.tolist()}

        def find(x, parent=parent):
            return x if parent[x] == x else find(parent[x])

        for n, p, i in rows:
            for m, q, j in rows:
                if n == m and (p ^ q).bit_count() < jaccard_join.CHAIN:
                    low, high = sorted((find(i), find(j)))
                    parent[high] = low
        assert pairs == sorted([find(i), i] for i in parent if find(i) != i)


@pytest.mark.parametrize("rule", [jaccard_join.Rule(4, 85), jaccard_join.Rule(5, 80)])
def test_candidate_links_of_near_copies_grow_with_rows_not_pairs(spark, rule):
    base = prose(91, 200)
    docs = [(k, near(base, 300 + k, 1 + k % 6)) for k in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    found = jaccard_join.candidate_links(frame, rule, 8)
    made = {(r["a"], r["b"]) for r in found.collect()}
    assert {x for pair in made for x in pair} == set(range(400))
    assert len(made) < 8 * 400


# ---- arrays of the language model -------------------------------------------------------------


def test_arrays_of_the_language_model_are_plain(tmp_path):
    keys = np.arange(5, dtype="u8")
    name = kneser_ney.save(str(tmp_path), [keys, keys.astype("u1")])
    held = kneser_ney.mapped(str(tmp_path), name, [("u8", 5), ("u1", 5)])
    assert [type(a) for a in held] == [np.ndarray, np.ndarray]
    assert [a.tolist() for a in held] == [keys.tolist()] * 2
    parts = list(kneser_ney._split(np.array([70000, 2, 70000, 0]), 70001))
    assert [(k, own.tolist()) for k, own in parts] == [(0, [3]), (2, [1]), (70000, [0, 2])]
