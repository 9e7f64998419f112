"""Periodic runs of words: stretches that repeat with a period and can't be extended.

Every run holds, for one of the two orders of words, a Lyndon word of its period's length that is
the longest at its position. That longest Lyndon word ends where the next smaller suffix begins,
so there are at most two candidates per word. Each is extended to both sides by the longest
common extension of its two ends, to the right over Ukkonen's suffix tree of the words and to the
left over that of their reversal, with constant-time lowest common ancestors on the Euler tours
(``suffix_tree``). What reaches the wanted length is a run.

Trees are built over the words that can lie in a run at all. A run with exponent ``e`` holds each
of its words ``floor(e)`` times, so a word with fewer occurrences in its stretch ends the stretch;
this is repeated until nothing changes. It is exact at any size and leaves little of ordinary
prose. The stretches of a slice of texts share one tree, divided by numbers that occur once.

Words are compared by 64-bit hashes. Memory grows with n log n for the n words of a slice's
stretches, or of a single text's if it is longer than a slice.

Defined results: a null text has no words, no runs and an empty collapsed text; repeated rows and
null ids are kept; all columns pass through, but those named like a result are replaced; an empty
table gives an empty table.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidemark.llm.batches import annotate
from tidemark.llm.suffix_tree import Extensions
from tidemark.llm.words import SPACED, Words

MIN_LENGTH = 6
MIN_EXPONENT = 4

RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
FIELDS = [
    StructField("n_words", LongType()),
    StructField("runs", ArrayType(RUN)),
    StructField("collapsed", StringType()),
]


def next_beyond(rank: list[int]) -> tuple[list[int], list[int]]:
    """For each position the next one with a smaller rank, and the next with a greater one."""
    n = len(rank)
    smaller, greater = [n] * n, [n] * n
    falling: list[int] = []
    rising: list[int] = []
    for i, r in enumerate(rank):
        while falling and rank[falling[-1]] > r:
            smaller[falling.pop()] = i
        while rising and rank[rising[-1]] < r:
            greater[rising.pop()] = i
        falling.append(i)
        rising.append(i)
    return smaller, greater


def find_runs(letters: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """(start, length, period) of all runs of ``letters`` (positive numbers) that are long enough."""
    n = len(letters)
    forward, backward = Extensions(letters.tolist()), Extensions(letters[::-1].tolist())
    ends = np.array(next_beyond(forward.rank[:n].tolist()), np.int64).ravel()
    starts = np.tile(np.arange(n), 2)
    right, left = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    inside = ends < n
    right[inside] = forward.common(starts[inside], ends[inside])
    inside = starts > 0
    left[inside] = backward.common(n - starts[inside], n - ends[inside])
    period, length = ends - starts, ends - starts + left + right
    long = length >= np.maximum(min_length, min_exponent * period)
    rows = np.stack([starts - left, length, period], axis=1)[long]
    rows = rows[np.lexsort(rows.T[::-1])]
    # a stretch is reported with its smallest period
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def stretches(words: np.ndarray, owner: np.ndarray, min_length: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that can lie in a run, and the number of each one's stretch."""
    at, stretch = np.arange(len(words)), owner.astype(np.int64)
    while True:
        before = len(at)
        order = np.lexsort((words[at], stretch))
        w, s = words[at[order]], stretch[order]
        new = np.ones(len(order), bool)
        new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
        group = np.cumsum(new) - 1
        keep = np.empty(len(order), bool)
        keep[order] = np.bincount(group, minlength=1)[group] >= least if len(order) else True
        at, stretch = at[keep], stretch[keep]
        if not len(at):
            return at, stretch
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (stretch[1:] != stretch[:-1])
        stretch = np.cumsum(cut) - 1
        long = np.bincount(stretch)[stretch] >= min_length
        at, stretch = at[long], stretch[long]
        if len(at) == before:
            return at, stretch


def runs_of(words: Words, min_length: int, min_exponent: int) -> np.ndarray:
    """(start, length, period) of all runs of all texts, starts counted over the whole slice."""
    distinct = np.unique(words.hashes, return_inverse=True)[1]
    at, stretch = stretches(distinct, words.owner(), min_length, min_exponent)
    if not len(at):
        return np.empty((0, 3), np.int64)
    kinds, letter = np.unique(distinct[at], return_inverse=True)
    first = np.flatnonzero(np.append(False, stretch[1:] != stretch[:-1]))  # of all but one stretch
    dividers = len(kinds) + 1 + np.arange(len(first))
    letters = np.insert(letter + 1, first, dividers)
    source = np.insert(at, first, -1)  # no run starts at a divider
    found = find_runs(letters, min_length, min_exponent)
    found[:, 0] = source[found[:, 0]]
    return found


def _kernel(min_length: int, min_exponent: int):
    def run(texts):
        raw = [b"" if t is None else t.encode() for t in texts]
        words = Words(raw, SPACED)
        found = runs_of(words, min_length, min_exponent)
        owner = np.searchsorted(words.first, found[:, 0], side="right") - 1
        # texts without words share their first word's number with the next text
        per_text: dict[int, list] = {}
        for text, (start, length, period) in zip(owner.tolist(), found.tolist(), strict=True):
            per_text.setdefault(text, []).append((start - int(words.first[text]), length, period))
        runs, collapsed = [], []
        for k, data in enumerate(raw):
            own, parts = sorted(per_text.get(k, [])), data.split()
            if own:
                change = np.zeros(len(parts) + 1, np.int64)
                spans = np.array(own)
                np.add.at(change, spans[:, 0] + spans[:, 2], 1)
                np.add.at(change, spans[:, 0] + spans[:, 1], -1)
                parts = compress(parts, (np.cumsum(change[:-1]) == 0).tolist())
            runs.append([dict(zip(RUN.names, r, strict=True)) for r in own])
            collapsed.append(b" ".join(parts).decode())
        return words.counts, runs, collapsed

    return run


def periodic_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, keep_text: bool = True
) -> DataFrame:
    """``docs`` with ``n_words``, all ``runs`` of at least ``min_length`` words and ``min_exponent``
    periods by start and period, and the text ``collapsed``: of each run one period stays, and
    words are joined by one space."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    return annotate(docs, lambda: _kernel(min_length, min_exponent), FIELDS, keep_text=keep_text)
