"""Operators over whole tables: groups, packing, pipeline, registration."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter

import pytest

from tests.llm.cases import components, documents, near, prose, words
from tidemark.llm import jaccard_join as jaccard
from tidemark.llm import packing
from tidemark.llm.tokens import WordEncoder, tokenizer_path
from tidemark.llm.words import SPACED_LOWER, Words, shingle_sets


def shingles(text):
    ws = words(text, True)
    return frozenset(tuple(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))) if ws else frozenset()


@pytest.mark.parametrize("block_rows", [3, 1024])
def test_groups_match_all_pairs(spark, block_rows, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_DOCUMENTS", 6)
    base = prose(50, 200)
    extra = [(1000 + k, near(base, 900 + k, k % 14), "en", "c", 1, "x") for k in range(60)]
    extra += [(2000 + k, prose(400 + k, 30) + " " + base[:300], "en", "c", 1, "x") for k in range(40)]
    from tests.llm.cases import rows

    data = rows() + extra
    random.Random(4).shuffle(data)
    found = jaccard.jaccard_groups(documents(spark, data), block_rows=block_rows).collect()
    sets: dict = {}
    for doc, text, *_ in data:
        if doc is not None:
            sets.setdefault(doc, set()).add(shingles(text))
    expected = components(sets, 85)
    assert len(found) == len(data)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in found) == Counter(
        (d, len(shingles(t))) for d, t, *_ in data
    )
    for row in found:
        assert row["component_id"] == expected.get(row["doc_id"])
    kept = jaccard.keep_first(documents(spark, data))
    wanted = [d for d, *_ in data if d is None or expected[d] == d]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(wanted)
    assert kept.columns == documents(spark, []).columns


def test_linking_pairs_always_share_a_block_number():
    rng = random.Random(8)
    rule = jaccard.Rule()
    for _ in range(300):
        n = rng.choice([1, 4, 7, 12, 20, 60, 300])
        whole = [prose(rng.randrange(10**6), n + 3)]
        own = shingle_sets(Words([whole[0]], SPACED_LOWER), 4)[0]
        drop, add = rng.randrange(1 + len(own) // 6), rng.randrange(1 + len(own) // 6)
        import numpy as np

        fresh = np.array([rng.getrandbits(64) for _ in range(add)], np.uint64)
        other = np.unique(np.concatenate([own[drop:], fresh]))
        if not len(other) or not rule.links(len(np.intersect1d(own, other)), len(own), len(other)):
            continue
        hot = np.sort(rng.sample(own.tolist(), rng.randrange(len(own) + 1)))
        hot = np.array(hot, np.uint64)
        numbers = [
            set(jaccard.block_numbers(s, jaccard.is_cold(s, hot), rule).tolist()) for s in (own, other)
        ]
        assert numbers[0] & numbers[1]


def test_empty_tables_have_no_groups(spark):
    assert jaccard.jaccard_groups(documents(spark, [])).count() == 0


def test_word_encoder_equals_the_tokenizer():
    from tests.llm.cases import texts
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    odd = ["it's 'tis. a,b ,, x!!. é. ’. <|endoftext|> ΑΣ. İ 日本。", "don't. x’s, ½. ", "á. b́, c"]
    cases = [*texts(), *odd]
    ids, counts = WordEncoder(tokenizer_path()).encode(cases)
    at = 0
    for text, n in zip(cases, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == plain.encode(text or "", add_special_tokens=False).ids
        at += n


def test_packing_is_whole_gapless_and_close_to_its_bound(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    docs = documents(spark)
    placed = packing.pack(docs).collect()
    expected = Counter()
    for row in docs.collect():
        ids = [*plain.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start : start + 2048]
            expected[row["doc_id"], piece, start, len(own), struct.pack(f"<{len(own)}I", *own)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in placed) == expected
    held: dict = {}
    for r in placed:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in held.values():
        end = 0
        for offset, length, _ in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    histogram = Counter(r["length"] for r in placed)
    assert len(held) <= sum(packing.best_fit_decreasing(histogram, 2048).values())
    made = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packing.pack(docs)).collect()}
    assert sorted(map(zlib.crc32, made.values())) == sorted(
        zlib.crc32(b"".join(i for *_, i in sorted(p))) for p in held.values()
    )
    assert packing.pack(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_cover_every_length(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 7, 100, rng.randrange(1, 2049), rng.randrange(600, 1400)]) for _ in range(3000)]
    plan = packing.solve(Counter(lengths))
    covered: Counter = Counter()
    for configuration, count in plan.uses:
        assert sum(length * copies for length, copies in configuration) <= 2048
        for length, copies in configuration:
            covered[length] += copies * count
    assert covered == Counter(lengths)
    best_fit = sum(packing.best_fit_decreasing(Counter(lengths), 2048).values())
    assert plan.lower_bound <= plan.sequences <= best_fit + 1


def test_registered_operators_match_their_sql(spark):
    from checks.compare import difference, duck
    from tidemark.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    con = duck(sf_dir)
    for name, sql in queries.ORACLE.items():
        assert difference(queries.QUERIES[name](spark, sf_dir), con, sql) is None, name
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages_keep_clean_documents_and_their_columns(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= before.count()
        before = after
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == before.count()


def test_pipeline_drops_near_copies_of_five_words_and_80_percent(spark):
    import corpus_pipeline

    def five(text):
        ws = words(text, True)
        return frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()

    share = lambda cut, a, b: len(cut(a) & cut(b)) / len(cut(a) | cut(b))
    data, between = [], 0
    for k in range(24):
        base = [f"d{k}w{j}" for j in range(96)]
        added = [*base, *(f"a{k}w{j}" for j in range(19 + k % 7))]
        scattered = [f"s{k}" if j in (20 + k % 9, 60) else w for j, w in enumerate(base)]
        other = " ".join(added if k % 2 else scattered)
        between += 0.8 <= share(five, " ".join(base), other) and share(shingles, " ".join(base), other) < 0.85
        data += [(d, t, "en", "c", 1, "x") for d, t in ((2 * k, " ".join(base)), (2 * k + 1, other))]
    assert between >= 20
    random.Random(6).shuffle(data)
    expected = components({d: {five(t)} for d, t, *_ in data}, 80)
    kept = corpus_pipeline.deduplicate(spark, documents(spark, data), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(d for d in expected if expected[d] == d)
    assert len(kept) < len(data) - 20
    assert (jaccard.SHINGLE, jaccard.PERCENT) == (4, 85)
