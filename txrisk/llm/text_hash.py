"""Vectorised 64-bit hashing of byte windows and word shingles (numpy, used inside tasks).

A window's hash is a polynomial over its bytes modulo 2**64, taken from one running sum, so a text of
n bytes costs O(n) whatever the window. ``mix`` spreads the bits afterwards. Equal windows always have
equal hashes; operators that must be exact compare bytes or treat a 64-bit clash inside one document
pair (probability below 1e-12) as impossible, and say which.
"""

from __future__ import annotations

import functools

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: One odd-looking 64-bit value per byte, so that short runs of small codes do not look alike.
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Longest stretch hashed with one table of powers; longer texts are hashed stretch by stretch.
_TABLE = 1 << 20


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _TABLE if n <= _TABLE else 1 << (n - 1).bit_length()
    up, down = _powers(size)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def running_sum(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte * base**i (one longer than the data), and base**-i."""
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return total, down


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` bytes; empty when the data is shorter."""
    if len(data) < width:
        return np.empty(0, dtype=np.uint64)
    total, down = running_sum(data)
    return mix((total[width:] - total[:-width]) * down[: len(data) - width + 1])


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word ``[^\\x20\\x09-\\x0D]+`` of the bytes, in order."""
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    edge = np.diff(~_SPACE[data], prepend=False, append=False)
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    total, down = running_sum(data)
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ (ends - starts).astype(np.uint64))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles.

    A text with fewer words than a shingle has its whole word sequence as its only shingle; a text
    without words has none.
    """
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix(out * _BASE + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()
