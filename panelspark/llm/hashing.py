"""Vectorised hashing of bytes and words over flat arrays.

A batch of documents is hashed with a few array passes instead of a Python loop over words. Hashes
have 64 bits and depend on content alone, so equal content has equal hashes in every task.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
#: Positions take the low bits of the values that are minimised, so a batch has at most so many values.
POSITION_BITS = 20
BATCH = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word."""
    x = (x ^ (x >> _SHIFT)) * _ODD
    x = (x ^ (x >> _SHIFT)) * _ODD
    return x ^ (x >> _SHIFT)


def _powers(inverse: bool) -> np.ndarray:
    step = np.full((1 << POSITION_BITS) + 1, pow(_BASE, -1, 1 << 64) if inverse else _BASE, dtype=np.uint64)
    step[0] = 1
    return np.multiply.accumulate(step)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if _UP is None:
        _UP, _DOWN = _powers(False), _powers(True)
    return _UP, _DOWN


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P[i] = sum over j < i of values[j] * base**j: any span's hash is then one subtraction away."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _tables()[0][: len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, stop), wherever they stand."""
    return mix((prefix[stop] - prefix[start]) * _tables()[1][start] + (stop - start).astype(np.uint64))


def gram_hashes(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive values."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = (prefix[k:] - prefix[:n]) * _tables()[1][:n]
    x ^= x >> _SHIFT
    x *= _ODD
    x ^= x >> _SHIFT
    return x


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of words (runs of bytes other than 0x20 and 0x09 to 0x0D) in documents that
    stand one after another, document d in data[bounds[d]:bounds[d + 1]]; and the words' own bounds."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, bounds)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(prefix: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined anchors of the documents in values (given by their prefix sums).

    Every window of ``window`` values inside one document is given to its smallest gram of ``gram``
    values, the leftmost of equals. That choice depends on the window's content alone, so equal windows
    have equal anchors at equal offsets. Returns for each anchor its position and the first and the last
    start of the windows given to it; these ranges together are all windows, each once.
    """
    n = len(prefix) - 1
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none
    low_bits = np.uint64((1 << POSITION_BITS) - 1)
    packed = (gram_hashes(prefix, gram) & ~low_bits) | np.arange(n - gram + 1, dtype=np.uint64)
    at = (sliding_min(packed, window - gram + 1) & low_bits).astype(np.int64)
    starts = np.flatnonzero(np.repeat(bounds[1:], np.diff(bounds))[: len(at)] >= np.arange(window, window + len(at)))
    if not len(starts):
        return none, none, none
    at = at[starts]
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    return at[cut], starts[cut], starts[np.concatenate((cut[1:], [len(starts)])) - 1]
