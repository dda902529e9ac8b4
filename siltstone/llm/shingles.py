"""Word shingles of many texts at once, as 64-bit hashes, by numpy over Arrow's text buffers.

Words are runs of bytes outside 0x20 and 0x09-0x0D, A-Z in lower case. A text's set holds the hashes
of its runs of five words; with one to four words, the hash of the whole sequence; without words it
is empty. Two different shingles of a pair of texts share a hash with a probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Texts are hashed about so many bytes at a time; a longer text on its own.
SLICE_BYTES = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_BASE = _U(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) | _U(1)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 64), _BASE)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _hash_slice(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    texts = len(bounds) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * texts
    space = _SPACE[data]
    fresh = np.zeros(len(data), bool)
    fresh[bounds[:-1][bounds[:-1] < len(data)]] = True
    begins = ~space
    begins[1:] &= space[:-1] | fresh[1:]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * texts
    at = np.arange(len(data))
    word_start = np.zeros(len(data), np.int64)
    word_start[starts] = starts
    at -= np.maximum.accumulate(word_start)
    weights = _power(int(at.max()) + 1)
    words = mix(np.add.reduceat(_BYTE[data] * weights[at], starts))
    # A hash for each place where five words begin; places that run over a text's end are left out below.
    runs = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        runs += words[k : k + len(runs)] * _PLACE[k]
    runs = mix(runs)
    out = []
    for i in range(texts):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= WIDTH:
            out.append(np.unique(runs[a : b - WIDTH + 1]))
        elif b > a:
            short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + _U(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; a null text has none."""
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        end = min(end, len(texts))
        yield from _hash_slice(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end
