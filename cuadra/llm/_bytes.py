"""Words of a text as ranges and hashes of its UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)]


def utf8(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


def word_edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it; blanks are 0x20 and 0x09 to 0x0D."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_and(data != 0x20, data - np.uint8(9) > 4, out=inside[1:-1])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word's bytes and their places."""
    starts, ends = word_edges(text)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    firsts = np.cumsum(lens) - lens
    # the words' bytes side by side, and the place of each in its word
    at = np.arange(firsts[-1] + lens[-1])
    h = at + np.repeat(starts - firsts, lens)
    place = (at - np.repeat(firsts, lens)).astype(np.uint64)
    h = (np.frombuffer(text, np.uint8)[h] + place * np.uint64(257) + np.uint64(1)) * _M[0]
    h ^= h >> np.uint64(29)
    h *= _M[1]
    h ^= h >> np.uint64(32)
    h = np.add.reduceat(h, firsts) * _M[0]
    return h ^ (h >> np.uint64(32))
