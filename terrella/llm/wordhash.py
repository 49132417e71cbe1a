"""64-bit hashes of the words of texts, computed over whole batches at once.

A word is a run of bytes other than white space (32 and 9 to 13); UTF-8 never uses those inside a character. Words of up to 64 bytes are
read in lanes of eight bytes, all words of a buffer in one array operation a lane, and each lane is mixed into the word's state;
longer words are hashed one by one with XXH64. Words of one length of up to eight bytes never share a hash.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of text that are hashed in one go, and lanes of eight bytes beyond which a word is hashed by itself.
HASHED_BYTES, LANES = 2_000_000, 8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n + n // 4, base))])
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum(values * powers(len(values))[0])])


def run_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each run start .. stop that depends on its values only."""
    return mixed((sums[stop] - sums[start]) * powers(len(sums))[1][start])


def _lane_hashes(part: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words of `part` (followed by eight more bytes) that begin at `begin`."""
    lanes = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
    state = size.astype(np.uint64) * _BASE
    at = None
    for k in range(min(LANES, -(-int(size.max(initial=0)) // 8))):
        if k:
            at = np.flatnonzero(size > 8 * k)
            lane = lanes[begin[at] + 8 * k] & _KEPT[np.minimum(size[at] - 8 * k, 8)]
            state[at] = mixed(state[at] * _BASE + lane)
        else:
            state = mixed(state + (lanes[begin] & _KEPT[np.minimum(size, 8)]))
    return mixed(state * _BASE)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of UTF-8 text and the byte it starts at."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + HASHED_BYTES)
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        part = data[at:stop] + bytes(8)
        inside = np.concatenate([[False], ~_SPACE[np.frombuffer(part, np.uint8, stop - at)], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[::2], edges[1::2]
        found = _lane_hashes(part, begin, end - begin)
        for i in np.flatnonzero(end - begin > 8 * LANES).tolist():
            found[i] = xxhash.xxh64_intdigest(part[begin[i] : end[i]], 42)
        hashes.append(found)
        starts.append(begin + at)
        at = stop
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.array([], np.uint64), np.array([], np.int64))


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the text each is of."""
    hashes, begin = word_hashes(b"\n".join(texts))
    stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return hashes, np.searchsorted(stops, begin, side="right")
