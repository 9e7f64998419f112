"""Token ids of many texts with a public tokenizer, one encoding per distinct word.

White space ends a word in this vocabulary: its normaliser, splitter and merges never look
across it. So a text's ids are the ids of its white-space separated strings in order, and each
task encodes only strings that it has not seen. ASCII letters are lower-cased first, as the
normaliser does, and a stop or comma at the end of a word is a piece of its own, as in the
splitter. The vocabulary's path is a parameter; each worker reads the file there.
"""

from __future__ import annotations

import os
import re

import numpy as np

from tidemark.llm.words import SPACED_LOWER, Words

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A stop or comma before white space that follows neither white space, nor an ASCII letter or
#: digit, nor a letter of U+00C0 to U+00FF.
_UNSAFE_STOP = re.compile(
    rb"(?<![a-z0-9 \t-\r])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,](?=[ \t-\r])"
)
CACHED_WORDS = 1_000_000
_ENCODERS: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def separated(text: str | None) -> bytes:
    """The text with white space before the stops and commas at the end of words, wherever the
    tokenizer makes them a piece of their own too."""
    if text is None:
        return b""
    raw = text.encode().translate(_LOWER)
    if not _UNSAFE_STOP.search(raw):
        raw = raw.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n")
    return raw


class WordEncoder:
    """Ids of whole texts; keeps those of up to ``CACHED_WORDS`` strings, then starts afresh."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.comma = self._encode(b",")[0]
        self._reset()

    def _reset(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted hashes, and where their ids lie in the pool
        self.begins = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        self.pool = np.empty(1 << 20, np.int32)
        self.used = 0

    def _encode(self, text: bytes) -> list[int]:
        found = self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)
        return found[0].ids

    def _encode_all(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, sizes). Strings without a comma are encoded in one call, with commas
        between them as separate pieces whose id tells where a string ends; others one by one."""
        plain = np.array([b"," not in w for w in strings], bool)
        begins, sizes = np.empty(len(strings), np.int64), np.empty(len(strings), np.int64)
        parts, used = [], 0
        if plain.any():
            joined = b" , ".join([*(w for w in strings if b"," not in w), b""])
            parts.append(np.array(self._encode(joined), np.int32))
            used = len(parts[0])
            ends = np.flatnonzero(parts[0] == self.comma)
            begins[plain] = np.append(0, ends[:-1] + 1)
            sizes[plain] = ends - begins[plain]
        for k in np.flatnonzero(~plain).tolist():
            parts.append(np.array(self._encode(strings[k]), np.int32))
            begins[k], sizes[k] = used, len(parts[-1])
            used += len(parts[-1])
        return np.concatenate(parts), begins, sizes

    def _learn(self, hashes: np.ndarray, strings: list[bytes]) -> None:
        flat, begins, sizes = self._encode_all(strings)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(flat)))
        self.pool[self.used : self.used + len(flat)] = flat
        known = np.append(self.known, hashes)
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.begins = np.append(self.begins, begins + self.used)[order]
        self.sizes = np.append(self.sizes, sizes)[order]
        self.used += len(flat)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after the other, and the number of each text; null is empty."""
        words = Words([separated(t) for t in texts], SPACED_LOWER)
        hashes, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHED_WORDS:
            self._reset()
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != hashes[inside]
        if new.any():
            spans = zip(
                words.starts[first[new]].tolist(), words.ends[first[new]].tolist(), strict=True
            )
            self._learn(hashes[new], [words.data[a:b] for a, b in spans])
            place = np.searchsorted(self.known, hashes)
        size = self.sizes[place][back]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.begins[place][back] - (ends - size), size)
        edges = np.append(0, ends)[np.append(0, np.cumsum(words.counts))]
        return self.pool[at], np.diff(edges)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
