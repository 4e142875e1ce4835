"""Per-document numpy kernels over UTF-8 bytes: words, 64-bit word hashes, rolling hashes.

Hashes are sums of random 64-bit byte values times powers of an odd multiplier (wrapping at 2^64),
finished with an avalanche step. They agree on every machine: the tables come from a fixed seed.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_POWER_BITS = 20
POWER = np.empty(1 << _POWER_BITS, dtype=np.uint64)
POWER[0] = 1
with np.errstate(over="ignore"):
    POWER[1:] = MULTIPLIER
    np.multiply.accumulate(POWER, out=POWER)
    INVERSE = np.empty_like(POWER)
    INVERSE[0] = 1
    INVERSE[1:] = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    np.multiply.accumulate(INVERSE, out=INVERSE)

#: A-Z to a-z, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: True for all but space and \x09-\x0D.
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Lower-cased ASCII letters, digits and all bytes of non-ASCII characters; other bytes become spaces.
ALNUM_OR_SPACE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def mixed(h: np.ndarray) -> np.ndarray:
    """The avalanche step of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> np.ndarray:
    """A 64-bit hash for each maximal run of word bytes, in order."""
    mask = is_word[data]
    change = np.zeros(len(mask) + 1, bool)
    if len(mask):
        change[0], change[-1] = mask[0], mask[-1]
        np.not_equal(mask[1:], mask[:-1], out=change[1:-1])
    edges = np.flatnonzero(change)
    if not len(edges):
        return np.empty(0, np.uint64)
    lengths = edges[1::2] - edges[0::2]
    if len(data) <= len(POWER):  # differences of running sums, moved to the word's start
        with np.errstate(over="ignore"):
            sums = np.empty(len(data) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(BYTE_VALUE[data] * POWER[: len(data)], out=sums[1:])
            h = (sums[edges[1::2]] - sums[edges[0::2]]) * INVERSE[edges[0::2]]
            return mixed(h + lengths.astype(np.uint64) * MULTIPLIER)
    first = np.cumsum(lengths) - lengths
    inside = data[mask]
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    place &= (1 << _POWER_BITS) - 1
    with np.errstate(over="ignore"):
        h = np.add.reduceat(BYTE_VALUE[inside] * POWER[place], first)
        return mixed(h + lengths.astype(np.uint64) * MULTIPLIER)


def starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    fresh = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
    return np.flatnonzero(fresh)


def combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` consecutive hashes."""
    n = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total += hashes[k : k + n] * POWER[k + 1]
        return mixed(total)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; shorter texts: the whole sequence as one; no words: none."""
    words = word_hashes(np.frombuffer(text.translate(LOWER), np.uint8))
    if not len(words):
        return words
    if len(words) < width:
        with np.errstate(over="ignore"):
            return mixed(np.array([(words * POWER[1 : len(words) + 1]).sum() + np.uint64(len(words))], np.uint64))
    found = np.sort(combined(words, width))
    return found[starts(found)]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of ``width`` bytes; ``data`` holds less than 2^20 bytes."""
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * POWER[:n], out=sums[1:])
        return (sums[width:] - sums[:-width]) * INVERSE[: n - width + 1]
