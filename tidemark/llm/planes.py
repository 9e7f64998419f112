"""Unsigned 64-bit arrays as compressed byte planes, for rows that carry many numbers."""

from __future__ import annotations

import numpy as np
import zstandard


def to_planes(array: np.ndarray) -> bytes:
    planes = array.astype(np.uint64).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def to_steps(array: np.ndarray) -> bytes:
    """For sorted arrays: the differences of neighbours."""
    return to_planes(np.diff(array.astype(np.uint64), prepend=np.uint64(0)))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)
