"""Word positions and hashes of whole Arrow string batches, by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
#: Bytes of text handled at once; a longer single text makes a longer piece.
PIECE_BYTES = 128 << 10

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower case.
NON_WORD = np.ones(256, bool)
NON_WORD[0x30:0x3A] = NON_WORD[0x61:0x7B] = NON_WORD[0x80:] = False

_powers = {"p": np.ones(1, U64), "i": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.full(max(n, PIECE_BYTES + 1), _P if kind == "p" else _P_INV, U64)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of whole rows; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the words before each row; no word crosses rows."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    here = np.append(inside, False)
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of bytes, the same wherever the word stands."""
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _power("p", n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("i", n + 1)[starts])


def sequences(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` neighbouring words; runs across rows are for the caller to leave out."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, U64)
    for k in range(size):
        out = out * U64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(out)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; with fewer words, the whole sequence; none: empty."""
    for first, end, data, offsets in pieces(texts):
        data = LOWER[data]
        starts, ends, at = bounds(data, offsets, SPACES)
        words = hashes(data, starts, ends)
        runs = sequences(words, size)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                yield sequences(words[a:b], int(b - a)) + U64(b - a)
            else:
                yield np.zeros(0, U64)
