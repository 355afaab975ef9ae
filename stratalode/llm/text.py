"""Words and windows of many texts at once: byte masks, and 64-bit hashes by prefix sums."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.RandomState(20240917)
_BYTE = _rng.randint(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_LENGTH, _WINDOW = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
_powers = {_STEP: np.ones(1, np.uint64), _BACK: np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that no word of [^\x20\x09-\x0D]+ holds, and bytes that no word of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ holds.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where in them each text begins (n + 1). parts: bytes between words."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = parts[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = gap[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(~gap & edge[:-1])
    edge[:-1] = gap
    edge[offsets] = True
    ends = np.flatnonzero(~gap & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order of their starts."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(starts, low + block)))
        high = int(ends[at:stop].max())
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * _power(_STEP, high - low), out=sums[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mix((sums[e] - sums[s]) * _power(_BACK, high - low)[s] + (e - s).astype(np.uint64) * _LENGTH)
        at = stop
    return out


def chain(hashes: np.ndarray, k: int, factor: np.uint64 = _WINDOW) -> np.ndarray:
    """A hash of every k consecutive hashes, len - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, U(k), np.uint64)
    for j in range(k):
        out *= factor
        out += hashes[j : j + n]
    return mix(out)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """For each of the chains over all words whether its k words are in one text. first: as words() gives it."""
    n = max(0, int(first[-1]) - k + 1)
    ok = np.ones(n, bool)
    for j in range(1, k):
        cut = first[1:-1] - j
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def text_of_word(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def chain_columns(hashes: np.ndarray, factor: np.uint64 = _WINDOW) -> np.ndarray:
    """One hash of each row of a table of hashes."""
    out = np.full(len(hashes), U(hashes.shape[1]), np.uint64)
    for j in range(hashes.shape[1]):
        out = out * factor + hashes[:, j]
    return mix(out)
