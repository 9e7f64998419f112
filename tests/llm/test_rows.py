"""Operators on single texts against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import LOWER, documents, prose, texts, words
from tidemark.llm import kneser_ney, pii, token_counts, warc
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.quality_rules import quality_rules, rule_columns

CLASSES = ["email", "ip", "card", "phone"]


def rules(text):
    ws, t = words(text), text or ""
    found = defaultdict(list)
    for k in range(len(ws) - 4):
        found[tuple(ws[k : k + 5])].append(k)
    hit = {k + j for at in found.values() if len(at) > 1 for k in at for j in range(5)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
    failed = len(ws) < 10 or 100 * len(hit) > 20 * len(ws)
    return (
        len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
        len(hit), failed,
    )


def test_rule_columns_match_plain_python():
    found = list(zip(*rule_columns(texts()), strict=True))
    assert found == [rules(t) for t in texts()]


@pytest.fixture(scope="module")
def labelled(spark):
    good = [(k, prose(k, 60)) for k in range(160)]
    bad = [(k, " ".join(f"{w}!!###" for w in prose(k, 50).upper().split())) for k in range(160, 240)]
    data = [(k, t, "en", "c", 1, "x") for k, t in (*good, *bad)]
    labels = [(k, int(k < 160), k % 2) for k in range(240)] + [(None, 1, 0), (5, None, None)]
    return documents(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_rules_learn_and_keep_every_row(spark, labelled):
    docs, labels = labelled
    found = {r["doc_id"]: r for r in quality_rules(docs, labels).collect()}
    assert sum(r["kept"] for k, r in found.items() if k < 160) >= 158
    assert not any(r["kept"] for k, r in found.items() if k >= 160)
    odd = quality_rules(documents(spark), labels)
    assert odd.count() == documents(spark).count() and odd.columns.count("kept") == 1
    unlabelled = quality_rules(documents(spark), labels.where("false")).select("probability").distinct()
    assert unlabelled.count() == 1
    assert quality_rules(documents(spark, []), labels).count() == 0


def test_positive_unlabelled_learning_separates_held_out_rows(spark, labelled):
    from tidemark.llm.pu_quality import estimate_prior, pu_quality

    docs, labels = labelled
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    trusted = labels.where(~held_out & (F.col("quality") == 1))
    scored = pu_quality(docs, trusted, docs.where(~held_out)).where(held_out).collect()
    right = [(r["score"] >= 0.5) == (r["doc_id"] < 160) == (r["predicted"] == 1) or
             (r["score"] < 0.5) == (r["doc_id"] >= 160) for r in scored]
    assert sum(right) >= 0.9 * len(right)
    none = pu_quality(documents(spark), trusted.where("false"), docs).collect()
    assert {r["score"] for r in none} == {0.5} and len(none) == documents(spark).count()
    import numpy as np

    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 3000), rng.normal(-4, 1, 3000)])
    assert abs(estimate_prior(positive, mixed) - 0.5) < 0.06


def test_toxicity_chain_flags_terms(spark):
    from tidemark.llm.toxicity import toxicity

    rng, data, labels = random.Random(3), [], []
    for k in range(600):
        parts = prose(1000 + k, 80).split(" ")
        if k % 4 == 0:
            for _ in range(3):
                parts.insert(rng.randrange(len(parts)), rng.choice(["idiot", "Moron", "trash", "stupid,"]))
        data.append((k, " ".join(parts), "en", "c", 1, "x"))
        if k < 400:
            labels.append((k, 1, int(k % 4 == 0)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity(documents(spark, data), labels).where("doc_id >= 400").collect()
    assert [r["is_toxic"] for r in found] == [r["doc_id"] % 4 == 0 for r in found]
    assert all(0 <= r[f"p_{c}"] <= 1 for r in found for c in ("insult", "contempt", "toxic"))
    assert not any(r["is_toxic"] for r in toxicity(documents(spark), labels).collect())
    assert toxicity(documents(spark), labels.where("false")).count() == documents(spark).count()


def test_toxicity_learns_from_few_labels_and_from_beginnings(spark):
    """40 labels; the held-out texts hold words with a beginning, none of which was labelled."""
    from tidemark.llm.toxicity import toxicity

    rng, data = random.Random(9), []
    for k in range(120):
        parts = prose(3000 + k, 60).split(" ")
        if k % 4 == 0:
            for j in range(3):
                parts.insert(rng.randrange(len(parts)), f"vilézo{'abcdefghij'[(k + j) % 10]}{k}")
        data.append((k, " ".join(parts), "en", "c", 1, "x"))
    labels = spark.createDataFrame(
        [(k, 1, int(k % 4 == 0)) for k in range(40)], "doc_id long, quality int, toxic int"
    )
    found = toxicity(documents(spark, data), labels).where("doc_id >= 40").collect()
    assert sum(r["is_toxic"] for r in found if r["doc_id"] % 4 == 0) >= 18
    assert not any(r["is_toxic"] for r in found if r["doc_id"] % 4)


def test_chain_on_a_small_matrix_matches_plain_regressions():
    """Each link by plain gradient descent on dense rows, earlier links predicted out of fold."""
    import numpy as np

    from tidemark.llm import toxicity as own
    from tidemark.llm.linear import Matrix

    rng = np.random.default_rng(2)
    dense = (rng.random((60, 5)) < 0.4).astype(float)
    first = ((dense[:, 0] + rng.random(60) * 0.9) > 0.8).astype(int)
    second = ((first + dense[:, 1] + rng.random(60)) > 1.4).astype(int)
    rows = [(np.flatnonzero(r).astype(np.int32), np.ones(int(r.sum()), np.float32)) for r in dense]

    def fit(x, y):
        w, b = np.zeros(x.shape[1]), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        for _ in range(60_000):
            r = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
            w, b = w - 0.5 * (x.T @ r + own.PENALTY * w), b - 0.5 * r.sum()
        return w, b

    chain = own.fit_chain(Matrix.of(rows), np.column_stack([first, second]), ["first", "second"])
    part, unseen = np.arange(60) % own.FOLDS, np.zeros(60)
    for fold in range(own.FOLDS):
        w, b = fit(dense[part != fold], first[part != fold])
        unseen[part == fold] = 1 / (1 + np.exp(-(dense[part == fold] @ w + b)))
    w, b = fit(dense, first)
    assert np.allclose(chain.weights[0, :5], w, atol=0.15) and abs(chain.offsets[0] - b) < 0.15
    wide = np.column_stack([dense, unseen])
    w, b = fit(wide, second)
    expected = wide @ w + b
    got = dense @ chain.weights[1, :5] + chain.links[1][0] * unseen + chain.offsets[1]
    assert np.allclose(1 / (1 + np.exp(-got)), 1 / (1 + np.exp(-expected)), atol=0.03)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PERSONAL = [
    "mail a.b@c.de, x@y @z a@b.c@d.e %@-.- é@ü.de q@w.e.r.", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.0004 1.2.3.255",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111 4111  1111", "+1 (017) 555-7713, ++49 30 12 +1+22 (3)",
    "9" * 5000 + "." + "1" * 3000, "@" * 3000 + "a" * 3000, "+1" + " " * 4000, "", None, "ünï 4111111111111111 ü",
]


def fixed(text):
    made = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = kind == "email"
            if kind == "ip":
                ok = all(len(p.lstrip("0")) < 4 and int(p[-9:]) <= 255 for p in m.group().split("."))
            if kind == "card":
                ok = 13 <= len(digits) <= 19 and pii.luhn(digits)
            if kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                made.append((kind, *m.span()))
    return made


def test_fixed_spans_match_the_patterns():
    rng = random.Random(1)
    noise = ["".join(rng.choice("a1.@+- ()9é_%") for _ in range(200)) for _ in range(300)]
    for text in [*PERSONAL[:4], *PERSONAL[6:], *noise]:
        assert pii.fixed_spans(text or "") == fixed(text), text
    assert pii.fixed_spans(PERSONAL[4]) == [] and pii.fixed_spans(PERSONAL[5]) == []


def test_confident_contexts_add_spans_and_base_spans_stay(spark):
    def card(k):
        body = f"4{k:014d}"
        return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))

    data = [(k, f"pay with card number {card(k)} soon w{k}") for k in range(40)]
    data += [(100, "pay with card number 4000000000000009 soon"), (101, "see 4000000000000009 there")]
    data += [(200 + k, t) for k, t in enumerate(PERSONAL)] + [(100, "pay with card number 4000000000000009 soon")]
    rows = [(k, t, "en", "c", 3, "x") for k, t in data] + [(None, None, None, None, None, None)]
    docs = documents(spark, rows)
    found = pii.personal_data(docs).collect()
    assert len(found) == len(rows)
    for row in found:
        base = [tuple(s) for s in row["base_spans"]]
        spans = [tuple(s) for s in row["spans"]]
        assert base == fixed(row["text"]) or len(row["text"] or "") > 1000
        new = [("card", 21, 37)] if row["doc_id"] == 100 else []
        assert spans == sorted([*base, *new], key=lambda s: (CLASSES.index(s[0]), s[1]))
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert masked[100] == "pay with card number [CARD] soon" and masked[101] == "see 4000000000000009 there"
    assert masked[7] == "pay with card number [CARD] soon w7" and masked[None] is None


def test_secrets_are_found_and_lend_their_contexts(spark):
    """Secrets after an assignment teach the words around them; what those words lead to becomes
    known and teaches the next context, which no fixed match has."""
    secret = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    data = [(k, f'they set token = "{secret(k)}" for service w{k}') for k in range(12)]
    data += [(50, f'they set token = "{secret(0)}')]
    data += [(60 + k, f"x{k} the bearer grant {secret(k)} q{k}") for k in range(12)]  # bare, known values
    data += [(80 + k, f"y{k} the bearer grant {secret(100 + k)} r{k}") for k in range(2)]  # one context on
    data += [(90, f"nothing before {secret(7)} comes"), (91, f"commit {secret(300)} of a log"), (92, "token = short1a2b3")]
    data += [(93, "token = " + "a1" * 40_000), (94, None), (95, "")]
    docs = documents(spark, [(k, t, "en", "c", 1, "x") for k, t in data])
    found = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    held = {k for k, r in found.items() if any(s["kind"] == "secret" for s in r["spans"])}
    assert held == {*range(12), 50, *range(60, 72), 80, 81, 93}
    assert not any(s["kind"] == "secret" for r in found.values() for s in r["base_spans"])
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert masked[3] == 'they set token = "[SECRET]" for service w3'
    assert masked[80] == "y0 the bearer grant [SECRET] r0" and masked[91].endswith("of a log")


def sure_patterns(rows, least):
    """Rounds over all edges with plain sets."""
    edges = {(k, p, v) for k, v, _, ps in rows for p in ps}
    seed_edges = {(k, p, v) for k, v, s, ps in rows if s for p in ps}
    known = {(k, v) for k, v, s, _ in rows if s}
    while True:
        sure = set()
        for kind, pattern in {e[:2] for e in edges}:
            values = {v for k, p, v in edges if (k, p) == (kind, pattern)}
            fixed_here = {v for v in values if (kind, pattern, v) in seed_edges}
            good = fixed_here | {v for v in values if (kind, v) in known}
            if 1 < len(values) and fixed_here != values and len(good) >= least * len(values):
                sure.add((kind, pattern))
        grown = known | {(k, v) for k, p, v in edges - seed_edges if (k, p) in sure}
        if grown == known:
            return sure
        known = grown


def test_bootstrapping_matches_plain_rounds(spark):
    rng = random.Random(4)
    for _ in range(3):
        rows = [
            (rng.choice("ab"), rng.randrange(30), rng.random() < 0.6, [f"p{rng.randrange(25)}" for _ in range(2)])
            for _ in range(90)
        ]
        frame = spark.createDataFrame(rows, "kind string, value long, seed boolean, patterns array<string>")
        names = spark.createDataFrame([(f"p{k}",) for k in range(25)], "name string").select(
            "name", F.xxhash64("name").alias("pattern")
        )
        got = pii.bootstrap(frame).join(names, "pattern").select("kind", "name")
        assert {tuple(r) for r in got.collect()} == sure_patterns(rows, pii.MIN_CONFIDENCE)
    assert pii.bootstrap(frame.where("false")).count() == 0


ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def hits(text, items):
    ws = ITEM_WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, own in items.items():
        size = min(10, len(own))
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(ws) - size + 1 if own else 0):
            if tuple(ws[k : k + size]) in grams:
                found.add(str(item))
                hit |= set(range(k, k + size))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("words_at_once", [25, 100_000])
def test_decontamination_matches_all_windows(spark, words_at_once):
    rng = random.Random(9)
    small = [" ".join(rng.choice("ab c d").strip() or "e" for _ in range(n)) for n in (1, 2, 3, 5, 9, 10, 11, 30, 40)]
    items = {k: t for k, t in enumerate([*small, *small[:2], None, "", "..", "Éa B-c"])}
    frame = spark.createDataFrame(list(items.items()), "item_id long, text string")
    own = {k: ITEM_WORD.findall((t or "").translate(LOWER)) for k, t in items.items()}
    noise = [" ".join(rng.choice(["a", "B", "c", "d", "e", "zz"]) for _ in range(n)) for n in (0, 1, 8, 60, 200)]
    data = [(k, t, "en", "c", 1, "q") for k, t in enumerate([*texts()[:12], *small, *noise, "x " + small[-1] + ", y"])]
    for row in decontaminate(documents(spark, data), frame, automaton_words=words_at_once).collect():
        n, n_hit, found = hits(row["text"], own)
        assert (row["n_words"], row["n_hit"], row["hit_items"]) == (n, n_hit, found)
        assert row["contaminated"] == (n_hit > 0) and row["removed"] == (n_hit > 0.5 * n)
        if n_hit:
            left = ITEM_WORD.findall(row["clean_text"].translate(LOWER))
            assert len(left) == n - n_hit
        else:
            assert row["clean_text"] == row["text"]
    none = decontaminate(documents(spark), frame.where("false"))
    assert none.where("contaminated").count() == 0 and none.count() == documents(spark).count()


def test_length_histogram_answers_every_limit(spark):
    docs = documents(spark)
    histogram = token_counts.length_histogram(docs)
    encode = token_counts.byte_encoding(token_counts.default_path()).encode_ordinary
    lengths = [len(encode(r["text"] or "")) for r in docs.collect()]
    for row in histogram.collect():
        n = row["n_tokens"]
        assert row["n_docs"] == lengths.count(n)
        assert row["docs_at_least"] == sum(x >= n for x in lengths)
        assert row["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert row["truncated_tokens"] == sum(min(x, n) for x in lengths)
        assert row["share_up_to"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    cut = {r["limit"]: r["tokens"] for r in token_counts.truncated_totals(histogram, [0, 7, 512]).collect()}
    assert cut == {n: sum(min(x, n) for x in lengths) for n in (0, 7, 512)}
    half = token_counts.quantiles(histogram, [0.5]).first()["n_tokens"]
    assert half == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    assert {r["lang"] for r in token_counts.length_histogram(docs, ["lang"]).collect()} == {"en", None}
    assert token_counts.length_histogram(documents(spark, [])).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_matches_plain_kneser_ney(spark, order):
    docs = documents(spark)
    training = docs.where("doc_id % 3 != 0")
    model = kneser_ney.train(training, order=order, shards=5)
    lists = lambda rows: [[*words(r["text"], True), None] for r in rows]
    train = lists(training.collect())
    counts = Counter(w for t in train for w in t)
    total, vocabulary = sum(counts.values()), len(counts)
    grams = [Counter(w for t in train for w in t)]
    for n in range(2, order + 1):
        grams.append(Counter(tuple(s[k : k + n]) for s in (["<s>", *t] for t in train) for k in range(len(s) - n + 1)))
    adjusted = [None] * order
    adjusted[-1] = grams[-1]
    for n in range(order - 1, 0, -1):
        ends = Counter(g[1:] if n > 1 else g[1] for g in grams[n])
        # Nothing precedes the begin mark: what starts with it keeps its own count.
        if n > 1:
            ends.update({g: c for g, c in grams[n - 1].items() if g[0] == "<s>"})
        adjusted[n - 1] = ends

    def discounts(table):
        n = [sum(c == k for c in table.values()) for k in (1, 2, 3, 4)]
        level = kneser_ney.Level([], [], [], [], counts_of_counts=n)
        return level.discounts()

    cut = [discounts(t) for t in adjusted]
    contexts = []
    for n in range(2, order + 1):
        held = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in adjusted[n - 1].items():
            held[g[:-1]][0] += c
            held[g[:-1]][min(c, 3)] += 1
        contexts.append(held)
    mass = sum(adjusted[0].values())
    left = sum(cut[0][min(c, 3)] for c in adjusted[0].values()) / mass
    scored = kneser_ney.score(docs, model).collect()
    assert len(scored) == docs.count()
    for row, own in zip(scored, lists(scored), strict=True):
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (vocabulary + 1))) for w in own)
        expected, seen = 0.0, ["<s>"]
        for w in own:
            seen.append(w)
            c = adjusted[0][w]
            p = max(c - cut[0][min(c, 3)], 0) / mass + left / (vocabulary + 1)
            for n in range(2, order + 1):
                if len(seen) < n:
                    continue
                held = contexts[n - 2].get(tuple(seen[-n:-1]))
                if held:
                    c = adjusted[n - 1][tuple(seen[-n:])]
                    rest = sum(cut[n - 1][k] * held[k] for k in (1, 2, 3)) / held[0]
                    p = max(c - cut[n - 1][min(c, 3)], 0) / held[0] + rest * p
            expected += math.log10(p)
        assert row["n_tokens"] == len(own) and row["n_known"] == sum(counts[w] > 0 for w in own)
        assert row["train_tokens"] == total
        assert row["base_score"] == pytest.approx(base) and row["score"] == pytest.approx(expected)
    empty = kneser_ney.score(docs, kneser_ney.train(docs.where("false"), shards=3)).collect()
    assert {r["n_known"] for r in empty} == {0} and all(r["score"] == 0 for r in empty)


def test_archives_round_trip_through_their_index(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 70_000, "<p>a</p>", "line\r\n\r\nbreak"]
    data = [(k, f"http://x.test/{k}\r\nEvil: 1" if k == 1 else f"http://x.test/{k}", h, k) for k, h in enumerate(html)]
    data += [(9, None, "<p>a</p>", 1), (10, "u", "z" * 300_000, 1)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, file int")
    folder = f"{warc.archive_folder(spark)}"
    index = warc.write_archives(pages, folder, file_bytes=1_000)
    assert index.count() == len(data) and index.select("file").distinct().count() > 1
    found = {r["page_id"]: r for r in warc.read_records(index, folder).collect()}
    first: dict = {}
    for page, _, text, _ in data:
        raw = (text or "").encode()
        name = warc.payload_digest(raw)
        leader = first.setdefault(raw, page)
        row = found[page]
        assert (row["payload_bytes"], row["payload_digest"]) == (len(raw), name)
        assert row["record_type"] == ("response" if leader == page else "revisit")
        assert row["refers_to"] == (None if leader == page else leader)
        assert row["payload"] == (raw if leader == page else None)
    some = warc.read_records(index.where("page_id IN (1, 7)"), folder)
    assert sorted(r["page_id"] for r in some.collect()) == [1, 7]
    longer = warc.write_archives(pages, warc.archive_folder(spark), least_bytes=9)
    assert longer.where("record_type = 'revisit'").count() == 0
    assert warc.write_archives(pages.where("false"), warc.archive_folder(spark)).count() == 0


def test_ranges_merge_neighbours_only():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("b", 0, 5), ("b", 6, 90)]
    merged = list(warc.ranges(rows, limit=50, gap=20))
    assert [m[:3] for m in merged] == [("a", 0, 15), ("a", 100, 105), ("b", 0, 5), ("b", 6, 96)]
    assert hashlib.sha1(b"").digest() and zlib.crc32(b"") == 0


def test_language_model_scores_depend_on_two_preceding_words(spark):
    """What follows "x b" and "y b" differs only by the word before last."""
    from tidemark.llm.kneser_ney import score, train

    seen = ["x b left", "y b right"] * 300 + [prose(k, 30) for k in range(40)]
    model = train(documents(spark, [(k, t, "en", "c", 1, "x") for k, t in enumerate(seen)]))
    asked = [(k, t, "en", "c", 1, "x") for k, t in enumerate(["x b left", "x b right", "y b left", "y b right"])]
    found = {r["doc_id"]: r["score"] for r in score(documents(spark, asked), model).collect()}
    assert found[0] > found[1] + 1 and found[3] > found[2] + 1


def test_first_word_is_conditioned_on_the_begin_mark(spark):
    """Half of the texts are "z q", all start with z: the first word is sure, the second even odds."""
    from tidemark.llm.kneser_ney import score, train

    seen = ["z q"] * 300 + [f"z r{k % 3}" for k in range(300)]
    rows = lambda texts: documents(spark, [(k, t, "en", "c", 1, "x") for k, t in enumerate(texts)])
    for order in (2, 3):
        found = {r["text"]: r["score"] for r in score(rows(["z q", "q z"]), train(rows(seen), order, 3)).collect()}
        assert found["z q"] == pytest.approx(math.log10(0.5), abs=0.02)
        assert found["q z"] < -3


def test_language_model_refuses_keys_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "LARGEST_BELOW", 3)
    with pytest.raises(ValueError, match="do not fit"):
        kneser_ney.train(documents(spark).select("text"), order=2, shards=2)
