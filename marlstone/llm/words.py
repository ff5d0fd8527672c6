"""Vectorised words of whole texts, for use inside tasks on Arrow batches.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. Every byte of a non-ASCII
character is 0x80 or more in UTF-8, so runs can be found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK_BYTES = 1 << 20  # of text worked on at once; a longer text is one chunk by itself

_bytes = np.arange(256)
LOWER = _bytes.astype(np.uint8)
LOWER[65:91] += 32
IN_WORD = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
_TABLE = np.random.default_rng(5).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of an odd base modulo 2**64, and their inverses."""
    if len(_powers[0]) < n:
        n2 = max(n + n // 4, 1 << 14)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            run = np.full(n2, base, np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """The words of consecutive texts: those of text ``i`` are ``first[i]`` to ``first[i + 1]``."""

    first: np.ndarray  # int64, one more than there are texts
    hashes: np.ndarray  # uint64
    starts: np.ndarray  # byte offsets in ``data``
    ends: np.ndarray
    data: np.ndarray  # lower-cased bytes of all texts
    offsets: np.ndarray  # of the texts in ``data``


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and their offsets; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` bytes, or one text."""
    _, offsets = text_bytes(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, len(texts))
        lo = hi


def find_words(texts: pa.Array, hashed: bool = True) -> Words:
    raw, offsets = text_bytes(texts)
    data = LOWER[raw]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = IN_WORD[data]
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    hashes = np.zeros(0, np.uint64)
    if hashed and len(starts):
        power, inverse = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * power[:n], out=sums[1:], dtype=np.uint64)
        hashes = mixed((sums[ends] - sums[starts]) * inverse[starts])
    return Words(np.searchsorted(starts, offsets), hashes, starts, ends, data, offsets)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every ``length`` consecutive values; shorter by ``length - 1``."""
    n = max(0, len(hashes) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mixed(out)
