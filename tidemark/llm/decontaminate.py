"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The automaton over the items' words is built once on the driver (items are split into automata
of at most ``AUTOMATON_WORDS`` words, each a broadcast of its own, so any number of items works)
and every training text is streamed through it: the state after each word gives the longest
match that ends there. A match of at least ``WINDOW`` words, or of a whole shorter item, is a
hit; hit spans are cut out, and a document whose share of hit words is above
``MAX_COVERAGE`` goes as a whole.

Words that no item holds, and neighbours that no item holds side by side, cannot continue a
match. Those two first transitions are looked up for all words of a slice at once, and only the
runs that remain are streamed word by word.

Defined results: a null text has no words; an item without words is ignored; repeated items
count by their ids; an item id that is null is ignored; repeated documents are judged one by
one; columns named like a result are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tidemark.llm.batches import annotate
from tidemark.llm.words import ALPHANUMERIC, Words

WINDOW = 10
MAX_COVERAGE = 0.5
AUTOMATON_WORDS = 100_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # before lower-casing


def item_words(text: str | None) -> list[int]:
    return Words([text], ALPHANUMERIC).hashes.tolist()


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers, with the items found at each state."""

    window: int
    vocabulary: dict[int, int] = field(default_factory=dict)
    moves: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Items whose window of ``window`` words belongs to the state, and short items ending there.
    windows: dict[int, set] = field(default_factory=dict)
    shorts: dict[int, dict[int, set]] = field(default_factory=dict)
    shortest: int = 1 << 30

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, target: int, word: int) -> int:
        """The state of the shorter strings of ``target`` that end after ``state`` and a word."""
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.moves[target]))
        self.link[target] = clone
        while state != -1 and self.moves[state].get(word) == target:
            self.moves[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        target = self.moves[last].get(word)
        if target is not None:
            if self.length[target] == self.length[last] + 1:
                return target
            return self._split(last, target, word)
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state != -1 and word not in self.moves[state]:
            self.moves[state][word] = new
            state = self.link[state]
        if state != -1:
            target = self.moves[state][word]
            whole = self.length[target] == self.length[state] + 1
            self.link[new] = target if whole else self._split(state, target, word)
        return new

    def build(self, items: list[tuple[object, list[int]]]) -> Automaton:
        numbered = []
        for item, words in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            last = 0
            for number in numbers:
                last = self._extend(last, number)
            numbered.append((item, numbers))
        for item, numbers in numbered:
            size = min(self.window, len(numbers))
            self.shortest = min(self.shortest, size)
            for state, matched in self.stream(numbers):
                if matched < size:
                    continue
                at = self.at_length(state, size)
                if size == self.window:
                    self.windows.setdefault(at, set()).add(item)
                else:
                    self.shorts.setdefault(at, {}).setdefault(size, set()).add(item)
        self._collect_shorts()
        return self

    def _collect_shorts(self) -> None:
        """Lists at each state all short items that end there, by its chain of suffixes."""
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            above = self.shorts.get(self.link[state]) if state else None
            if above:
                own = self.shorts.setdefault(state, {})
                for size, items in above.items():
                    own[size] = own.get(size, set()) | items

    def at_length(self, state: int, size: int) -> int:
        """The state that holds the last ``size`` words of a match in ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def stream(self, numbers):
        """(state, longest match) after each word."""
        state = matched = 0
        moves, link, length = self.moves, self.link, self.length
        for number in numbers:
            while state and number not in moves[state]:
                state = link[state]
                matched = length[state]
            if number in moves[state]:
                state = moves[state][number]
                matched += 1
            yield state, matched

    def hits(self, numbers):
        """(end, size, items) of every window or short item in a run of known words."""
        for end, (state, matched) in enumerate(self.stream(numbers), 1):
            if matched >= self.window:
                found = self.windows.get(self.at_length(state, self.window))
                if found:
                    yield end, self.window, found
            for size, items in self.shorts.get(state, {}).items():
                if size <= matched:
                    yield end, size, items

    def neighbours(self) -> np.ndarray:
        """Sorted codes of all pairs of words that stand side by side in an item."""
        width = len(self.vocabulary)
        codes = [
            first * width + second
            for first, state in self.moves[0].items()
            for second in self.moves[state]
        ]
        return np.unique(np.array(codes, np.int64))


class Scanner:
    """Streams slices of texts through one automaton."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.pairs = automaton.neighbours()
        hashes = np.array(list(automaton.vocabulary), np.uint64)
        self.order = np.argsort(hashes)
        self.known = hashes[self.order]

    def scan(self, words: Words) -> list[tuple[int, int, int, set]]:
        """(text, first word, end, items) of every hit; words are numbered within the slice."""
        auto = self.automaton
        place = np.minimum(np.searchsorted(self.known, words.hashes), len(self.known) - 1)
        known = self.known[place] == words.hashes
        ids = np.where(known, self.order[place], -1)
        owner = words.owner()
        joined = known[1:] & known[:-1] & (owner[1:] == owner[:-1])
        at = np.flatnonzero(joined)
        if len(at):
            code = ids[at] * len(auto.vocabulary) + ids[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[at[self.pairs[place] != code] if len(self.pairs) else at] = False
        # a run starts at a known word that does not continue one
        begins = np.flatnonzero(known & ~np.append(False, joined))
        ends = np.flatnonzero(known & ~np.append(joined, False)) + 1
        long = ends - begins >= auto.shortest
        found = []
        for begin, end in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            for last, size, items in auto.hits(ids[begin:end].tolist()):
                found.append((int(owner[begin]), begin + last - size, begin + last, items))
        return found


def automata(items: DataFrame, window: int, limit: int, item_id="item_id") -> list[Automaton]:
    """Automata of at most about ``limit`` words each. Items are few and short, test sets that
    people wrote; they are read through the driver one by one, never all at once."""
    made, held, size = [], [], 0
    for item, text in items.where(F.col(item_id).isNotNull()).select(item_id, "text").toLocalIterator():
        words = item_words(text)
        if not words:
            continue
        if held and size + len(words) > limit:
            made.append(Automaton(window).build(held))
            held, size = [], 0
        held.append((item, words))
        size += len(words)
    return [*made, Automaton(window).build(held)] if held else made


SPANS = ArrayType(
    StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
)
FIELDS = [
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("hit_items", ArrayType(StringType())),
    StructField("hit_spans", SPANS),
    StructField("clean_text", StringType()),
    StructField("contaminated", BooleanType()),
    StructField("removed", BooleanType()),
]


def word_runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def cut_out(text: str, hit: np.ndarray) -> tuple[list[dict], str]:
    """Character spans of the runs of hit words, and the text without them."""
    places = [m.span() for m in _WORD.finditer(text)]
    spans = [(places[a][0], places[b - 1][1]) for a, b in word_runs(hit)]
    kept, last = [], 0
    for start, end in spans:
        kept.append(text[last:start])
        last = end
    kept.append(text[last:])
    return [{"start": a, "end": b} for a, b in spans], "".join(kept)


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
    automaton_words: int = AUTOMATON_WORDS, keep_text: bool = True,
) -> DataFrame:
    """``docs`` with word counts, the items found (as strings, sorted), the hit spans in code
    points, the text without them, whether anything was hit and whether more than
    ``max_coverage`` of the words were."""
    context = docs.sparkSession.sparkContext
    held = [context.broadcast(a) for a in automata(items, window, automaton_words)]

    def kernel():
        scanners = [Scanner(one.value) for one in held]

        def judge(texts):
            words = Words(texts, ALPHANUMERIC)
            counts, starts = words.counts, words.first
            hit = np.zeros(len(words.hashes), bool)
            found: list[set] = [set() for _ in texts]
            for scanner in scanners:
                for text, first, end, which in scanner.scan(words):
                    hit[first:end] = True
                    found[text] |= which
            spans, clean = [], []
            n_hit = np.zeros(len(texts), np.int64)
            for k, text in enumerate(texts):
                if found[k]:
                    own = hit[starts[k] : starts[k] + counts[k]]
                    n_hit[k] = own.sum()
                    where, rest = cut_out(text, own)
                else:
                    where, rest = [], text
                spans.append(where)
                clean.append(rest)
            texts_left = [clean] if keep_text else []
            return [
                counts, n_hit, [sorted(map(str, x)) for x in found], spans, *texts_left,
                n_hit > 0, n_hit > max_coverage * counts,
            ]

        return judge

    fields = FIELDS if keep_text else [f for f in FIELDS if f.name != "clean_text"]
    return annotate(docs, kernel, fields, keep_text=keep_text)
