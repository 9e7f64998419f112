"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Matches of the fixed patterns are seeds, and so are secrets: strings of letters and digits that a
word like ``token`` or ``password`` is set to. Every seed, and every other string with the shape of
some kind (a candidate), yields lexical patterns: the two words to its left, the two to its right,
one on each side. Patterns and values form a graph, with one edge however often it was seen, that
Spark scores in rounds:

    pattern = share of its values that are known
    value   = score of its best pattern, 1 if it is known

Known are at first the seeds. A candidate that reaches ``MIN_CONFIDENCE`` becomes known, so that it
is a seed of the next round and may lift patterns which no fixed match has; rounds end when none is
added. As a candidate counts against its own pattern, four known values must speak for it at 0.8,
and four more for every other open candidate there. Candidates next to a pattern of that score are
reported with its kind, wherever they stand in such a context; base spans always stay.

All passes but the first work on the narrow table of mentions. Scores are aggregates with
map-side sums; joins spread a pattern or value that holds a third of all mentions over ``SALTS``
keys. New spans meet their documents in a join that Spark plans by measured size.

Defined results: a null or empty text has no spans; repeated rows get the same spans; an id may
be null or occur with several texts (mentions are keyed by id and text hash); columns named like
a result are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tidemark.llm.batches import annotate, bounded_batches, slices, texts_of, written

KINDS = ["email", "ip", "card", "phone"]
SECRET = "secret"
MIN_CONFIDENCE = 0.8
SALTS = 16

#: Fixed patterns. Possessive forms match the same strings without trying shorter ones.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9](?:[ ().-]{0,2}[0-9])++")
#: A secret and the words that it is set to.
_ASSIGNED = re.compile(
    r"(?i:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)[\"']?[ \t]{0,4}[:=]"
    r"[ \t]{0,4}[\"']?([A-Za-z0-9_+/-]{12,}+)"
)
_OPAQUE = re.compile(r"[A-Za-z0-9_+/-]++")
LEAST_OPAQUE = 16  # characters of a string without meaning, which may be a secret


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Left of each @ the longest run of local characters, right of it a dotted name. The run is
    walked back from the @, so a long text without one costs nothing."""
    found, floor, at = [], 0, text.find("@")
    while at != -1:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            floor = match.end()
            found.append((start, floor))
        at = text.find("@", max(at + 1, floor))
    return found


def _valid_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))


def _valid_card(text: str) -> bool:
    digits = digits_of(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def fixed_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = [("email", a, b) for a, b in emails(text)]
    for kind, pattern, valid in (
        ("ip", _IP, _valid_ip),
        ("card", _CARD, _valid_card),
        ("phone", _PHONE, lambda s: 9 <= len(digits_of(s)) <= 15),
    ):
        found += [(kind, *m.span()) for m in pattern.finditer(text) if valid(m.group())]
    return found


def _mixed(text: str) -> bool:
    """Letters and digits alternate, as they do not in words, numbers, dates and names."""
    return len(re.findall("[A-Za-z]+[0-9]", text)) >= 3


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    return [(SECRET, *m.span(1)) for m in _ASSIGNED.finditer(text) if _mixed(m.group(1))]


def outside(
    spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]
) -> list[tuple[str, int, int]]:
    """The spans that touch none of ``taken``."""
    starts, reach, last = [], [], 0
    for a, b in sorted((a, b) for _, a, b in taken):
        last = max(last, b)
        starts.append(a)
        reach.append(last)
    free = []
    for kind, a, b in spans:
        before = bisect_right(starts, b - 1)
        if not before or reach[before - 1] <= a:
            free.append((kind, a, b))
    return free


def candidate_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Strings shaped like a kind that touch no seed, once per kind they may be."""
    opaque = [
        (SECRET, *m.span())
        for m in _OPAQUE.finditer(text)
        if m.end() - m.start() >= LEAST_OPAQUE and _mixed(m.group())
    ]
    opaque = outside(opaque, taken)
    spans = []
    at = text.find("@")
    while at != -1:
        start, end = at, at + 1
        while start and text[start - 1] in _LOCAL:
            start -= 1
        while end < len(text) and text[end] in _LOCAL:
            end += 1
        if start < at and end > at + 1:
            spans.append(("email", start, end))
        at = text.find("@", end)
    for match in _DIGITS.finditer(text):
        found = match.group()
        digits = len(digits_of(found))
        if found.count(".") == 3 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", found):
            spans.append(("ip", *match.span()))
        elif 13 <= digits <= 19:
            spans.append(("card", *match.span()))
        if 7 <= digits <= 15:
            spans.append(("phone", *match.span()))
    return [*outside(spans, [*taken, *opaque]), *opaque]


def _words_before(text: str, at: int) -> list[str]:
    return re.sub("[0-9]", "0", text[max(0, at - 80) : at].lower()).split()[-2:]


def _words_after(text: str, at: int) -> list[str]:
    return re.sub("[0-9]", "0", text[at : at + 80].lower()).split()[:2]


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span; the edge of the text is a word of its own."""
    left = (["^", *_words_before(text, start)])[-2:]
    right = [*_words_after(text, end), "$"][:2]
    return [
        f"l {' '.join(left)}", f"r {' '.join(right)}", f"m {left[-1]} {right[0]}"
    ]


SPAN = StructType(
    [
        StructField("kind", StringType()),
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
    ]
)
_MENTION = (
    "doc_id {id}, text_hash long, kind string, start int, end int, seed boolean, value long, "
    "patterns array<string>"
)


def mentions(docs: DataFrame) -> DataFrame:
    """Seeds and candidates with their patterns, one row each."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = rows.where(F.col("text").rlike("[0-9@]"))
    schema = _MENTION.format(id=rows.schema["doc_id"].dataType.simpleString())

    def run(batches):
        for whole in batches:
            id_type = whole.schema.field("doc_id").type
            for batch in slices(whole, "text"):
                ids, hashes = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash"))
                made = []
                for k, text in enumerate(texts_of(batch, "text")):
                    seeds = [*fixed_spans(text), *secret_spans(text)]
                    others = candidate_spans(text, seeds)
                    for seed, spans in ((True, seeds), (False, others)):
                        for kind, a, b in spans:
                            value = xxhash.xxh3_64_intdigest(text[a:b].encode()) >> 1
                            made.append(
                                (ids[k], hashes[k], kind, a, b, seed, value, contexts(text, a, b))
                            )
                columns = list(zip(*made, strict=True)) or [()] * 8
                types = [
                    id_type, pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(),
                    pa.int64(), pa.list_(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["doc_id", "text_hash", "kind", "start", "end", "seed", "value", "patterns"],
                )

    return rows.mapInArrow(run, schema)


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.hash(by), F.lit(SALTS)))


def _for_each_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _hashed_patterns():
    return F.explode(F.transform("patterns", lambda p: F.xxhash64(p))).alias("pattern")


def bootstrap(found: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(kind, pattern) of the patterns that reach ``min_confidence`` when no round adds a value.

    Left out at first is what no round can change: patterns of one value, which would have to
    vouch for itself, and patterns of seeds alone.
    """
    edges = found.select("kind", "value", "seed", _hashed_patterns())
    edges = edges.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"))
    edges = written(edges, "pii-edges")
    patterns = edges.groupBy("kind", "pattern").agg(
        F.count_if("seed").alias("seeds"), F.count("*").alias("values")
    )
    patterns = written(patterns.where("values > 1 AND seeds < values"), "pii-patterns")
    seeds = written(found.where("seed").select("kind", "value").distinct(), "pii-seeds")
    on_pattern = ["kind", "pattern", "salt"]
    still_open = written(
        _salted(edges.where(~F.col("seed")), "value")
        .join(_for_each_salt(patterns.select("kind", "pattern")), on_pattern)
        .select("kind", "pattern", "value"),
        "pii-open",
    )
    known, added, number = seeds, seeds, patterns.select("kind", "pattern", "seeds", "values")
    while True:
        # Open edges of what was just added: its patterns gain a known value each.
        touched = _salted(still_open, "pattern").join(
            _for_each_salt(added), ["kind", "value", "salt"]
        )
        gains = touched.groupBy("kind", "pattern").agg(F.count("*").alias("gained"))
        number = written(
            number.join(gains, ["kind", "pattern"], "left").select(
                "kind", "pattern", (F.col("seeds") + F.coalesce("gained", F.lit(0))).alias("seeds"), "values"
            ),
            "pii-scores",
        )
        sure = number.where(F.col("seeds") >= F.lit(min_confidence) * F.col("values"))
        reached = (
            _salted(still_open, "value")
            .join(_for_each_salt(sure.select("kind", "pattern")), on_pattern)
            .select("kind", "value")
            .distinct()
        )
        added = written(reached.join(known, ["kind", "value"], "left_anti"), "pii-added")
        if added.isEmpty():
            return sure.select("kind", "pattern")
        known = written(known.unionByName(added), "pii-known")


def discovered(found: DataFrame, sure: DataFrame) -> DataFrame:
    """(doc_id, text_hash, _added_spans): secrets, and candidates next to a ``sure`` pattern."""
    others = found.where(~F.col("seed")).select(
        "doc_id", "text_hash", "start", "end", "kind", _hashed_patterns()
    )
    others = _salted(others, "text_hash").join(_for_each_salt(sure), ["kind", "pattern", "salt"])
    names = ["doc_id", "text_hash", "start", "end", "kind"]
    secrets = found.where(F.col("seed") & (F.col("kind") == SECRET))
    spans = (
        secrets.select(*names)
        .unionByName(others.select(*names))
        .groupBy("doc_id", "text_hash", "start", "end")
        .agg(F.min("kind").alias("kind"))
    )
    return spans.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("_added_spans")
    )


def _fixed_column(texts):
    return [[{"kind": k, "start": a, "end": b} for k, a, b in fixed_spans(t or "")] for t in texts]


def personal_data(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``base_spans`` (fixed patterns) and ``spans`` (these, secrets and the
    discovered)."""
    found = written(mentions(docs.select("doc_id", "text")), "pii-mentions")
    added = discovered(found, bootstrap(found))
    span = ArrayType(SPAN)
    marked = annotate(
        docs.withColumn("_text_hash", F.xxhash64("text")),
        lambda: lambda texts: [_fixed_column(texts)],
        [StructField("base_spans", span)],
        keep_text=keep_text,
    )
    kinds = F.array(*map(F.lit, [*KINDS, SECRET]))
    place = lambda x: F.struct(F.array_position(kinds, x["kind"]), x["start"])
    ordered = F.array_sort(
        F.concat("base_spans", F.coalesce("_added_spans", F.array().cast(span))),
        lambda x, y: F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0),
    )
    added = added.withColumnRenamed("doc_id", "_added_id").withColumnRenamed("text_hash", "_hash")
    return (
        marked.join(
            added,
            F.col("doc_id").eqNullSafe(F.col("_added_id")) & (F.col("_text_hash") == F.col("_hash")),
            "left",
        )
        .withColumn("spans", ordered)
        .drop("_text_hash", "_added_id", "_hash", "_added_spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets."""
    return mask(personal_data(docs)).drop("base_spans", "spans")


def mask(marked: DataFrame) -> DataFrame:
    columns = marked.columns
    bounded_batches(marked.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                spans = batch.column("spans").to_pylist()
                texts = [
                    masked(t, s) for t, s in zip(texts_of(batch, "text"), spans, strict=True)
                ]
                arrays = [
                    pa.array(texts, pa.string()) if c == "text" else batch.column(c)
                    for c in columns
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return marked.mapInArrow(run, marked.schema)


def masked(text: str | None, spans: list[dict]) -> str | None:
    """Overlapping spans are replaced together, under the kind of the first."""
    if not text or not spans:
        return text
    parts, last = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= last:
            parts += [text[last : span["start"]], f"[{span['kind'].upper()}]"]
        last = max(last, span["end"])
    return "".join([*parts, text[last:]])


def span_text(column: str):
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(
        F.transform(
            column,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def count_kind(column: str, kind: str):
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast(LongType())
