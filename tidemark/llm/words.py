"""Words of many texts at once, as 64-bit hashes.

A slice of texts is one byte array. Words are the runs between separator bytes; the hash of a
word is a polynomial over its bytes, read off running sums for all words together, so no word
becomes a Python object unless somebody asks for it. Two different words, or sequences, count
as equal only if 64 bits collide.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.uint64(0xBF58476D1CE4E5B9)
_SECOND = np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


class Alphabet:
    """Which bytes belong to words, and a number for each; case is ignored for A-Z or not."""

    def __init__(self, separators: bytes, lower: bool):
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        self.folded = np.arange(256, dtype=np.uint64)
        if lower:
            self.folded[65:91] += np.uint64(32)
        self.codes = mix((self.folded + np.uint64(1)) * _ODD)


SPACES = b" \t\n\v\f\r"
SPACED = Alphabet(SPACES, lower=False)
SPACED_LOWER = Alphabet(SPACES, lower=True)
ALPHANUMERIC = Alphabet(
    bytes(c for c in range(128) if not chr(c).isalnum()), lower=True
)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n + n // 4, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


class Words:
    """Words of a slice of texts in order: ``hashes``, byte ``starts`` and ``ends`` in ``data``,
    ``counts`` per text and the number of each text's ``first`` word. None has no words."""

    def __init__(self, texts, alphabet: Alphabet = SPACED):
        raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode() for t in texts]
        self.data = b"\n".join([*raw, b""])
        array = np.frombuffer(self.data, np.uint8)
        inside = alphabet.inside[array]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.append(0, edges)
        self.starts, self.ends = edges[::2], edges[1::2]  # the last byte is a separator
        powers, inverse = _powers(len(array))
        sums = np.cumsum(alphabet.codes[array] * powers[: len(array)], dtype=np.uint64)
        before = np.where(self.starts > 0, sums[self.starts - 1], np.uint64(0))
        value = (sums[self.ends - 1] - before) * inverse[self.starts]
        size = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mix(value + size * _ODD)
        begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
        cuts = np.searchsorted(self.starts, begins)
        self.first, self.counts = cuts[:-1], np.diff(cuts)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, first word) of every window of ``size`` words within one text."""
        per_text = np.maximum(self.counts - size + 1, 0)
        text = np.repeat(np.arange(len(per_text)), per_text)
        first = np.cumsum(per_text) - per_text
        return text, np.arange(len(text)) - first[text] + self.first[text]


def sequence_hashes(hashes: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each start on."""
    total = np.full(len(start), size, np.uint64)
    for step in range(size):
        total = mix(total * _ODD + hashes[start + step])
    return total


def hash_words(words: list[bytes], alphabet: Alphabet) -> np.ndarray:
    """Hashes of single words."""
    return Words(words, alphabet).hashes


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``size`` words each, the whole sequence if
    it is shorter, nothing without words. Sequences of different lengths never count as equal."""
    text, start = words.windows(size)
    rolled = sequence_hashes(words.hashes, start, size)
    bounds = np.concatenate([[0], np.cumsum(np.maximum(words.counts - size + 1, 0))])
    sets = []
    for k, n in enumerate(words.counts.tolist()):
        if n >= size:
            sets.append(np.unique(rolled[bounds[k] : bounds[k + 1]]))
        elif n:
            sets.append(sequence_hashes(words.hashes, words.first[k : k + 1], n))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
