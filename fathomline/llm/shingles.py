"""Word shingles of Arrow text batches as 64-bit fingerprints, computed on whole buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import FORGET

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Work is cut into pieces of about so many bytes, so memory doesn't follow the batch.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.up, self.down = _powers(_BASE, 1), _powers(_BASE_INVERSE, 1)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        return self.up, self.down


_POWERS = Powers()
FORGET.append(_POWERS.forget)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[offsets[i]:offsets[i+1]], and the number of words up to each text."""
    base, end = int(offsets[0]), int(offsets[-1])
    data, offsets = data[base:end], offsets - base
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] |= inside[edges]  # a text's first byte doesn't continue the text before it
    starts = np.flatnonzero(begins)
    spaces = np.concatenate((np.flatnonzero(~inside), [n]))
    stops = spaces[np.searchsorted(spaces, starts)]
    text_ends = offsets[np.searchsorted(offsets, starts, side="right")]
    stops = np.minimum(stops, text_ends)
    up, down = _POWERS.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


_PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    total = words[: n - size + 1] * _PLACE[0]
    for k in range(1, size):
        total = total + words[k : n - size + 1 + k] * _PLACE[k]
    return mix(total + np.uint64(size))


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    if len(values) > 1:
        fresh = np.empty(len(values), bool)
        fresh[0] = True
        np.not_equal(values[1:], values[:-1], out=fresh[1:])
        values = values[fresh]
    return values


def shingle_sets(column: pa.Array, size: int):
    """Yields the sorted distinct shingle hashes of each text of a string column; null has none."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    if len(column) == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        upto = min(upto, len(column))
        hashes, counts = word_hashes(data, offsets[at : upto + 1])
        for i in range(upto - at):
            yield distinct(shingle_hashes(hashes[counts[i] : counts[i + 1]], size))
        at = upto
