"""Word shingles, one-permutation sketches and band keys of texts, for use inside Spark tasks."""

from __future__ import annotations

import functools

import numpy as np

SHINGLE = 5
#: 24 bands of 4 bins. A pair at similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 24, 4
BINS = BANDS * ROWS
PIECE = 1 << 20

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_STEP = U(0xD6E8FEB86659FD93)

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64) + U(1)
_LOWER[65:91] += U(32)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of a public hash)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, U), np.full(n, _INVERSE, U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and digests of the words of one piece."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_WHITE[data]
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(max(PIECE, 1 << int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_LOWER[data] * up[: len(data)], out=total[1:])
    digest = (total[ends] - total[starts]) * down[starts]
    return starts, mix(digest + (ends - starts).astype(U) * _STEP)


def word_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words, A-Z lower-cased, and where each text's words start in them."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    places, digests, at = [], [], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):  # not inside a word
            while end < len(data):
                white = np.flatnonzero(_WHITE[data[end : end + PIECE]])
                if len(white):
                    end += int(white[0])
                    break
                end += PIECE
        starts, found = _piece(data[at:end])
        places.append(starts + at)
        digests.append(found)
        at = end
    if not places:
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(digests), np.searchsorted(np.concatenate(places), begins)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle digests of each text."""
    words, at = word_digests(texts)
    n = len(words) - SHINGLE + 1
    every = np.zeros(max(n, 0), U)
    for k in range(SHINGLE if n > 0 else 0):
        every = every * _STEP + words[k : k + n]
    every = mix(every)
    sets = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= SHINGLE:
            sets.append(np.unique(every[a : b - SHINGLE + 1]))
        elif b > a:  # the whole sequence as one, told apart from longer ones by its length
            one = np.zeros(1, U)
            for w in words[a:b]:
                one = one * _STEP + w
            sets.append(mix(one + U(b - a)))
        else:
            sets.append(np.zeros(0, U))
    return sets


@functools.lru_cache(1)
def _probes() -> np.ndarray:
    """For each bin the order in which it would borrow from the others."""
    draw = np.random.default_rng(20170807)
    return np.argsort(np.argsort(draw.random((BINS, BINS)), axis=1), axis=1).astype(np.int32)


def bands(found: np.ndarray) -> np.ndarray:
    """The band keys of a sorted, non-empty shingle set.

    One permutation: the upper bits of a digest choose its bin and the least digest of a bin
    stands for it. Optimal densification: an empty bin takes the value of a bin drawn uniformly
    from the occupied ones, by an order that depends on the empty bin alone.
    """
    where = ((found >> U(32)) * U(BINS)) >> U(32)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    full = where[first].astype(np.int64)
    least = np.zeros(BINS, U)
    least[full] = found[first]
    if len(full) < BINS:
        empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
        order = _probes()[empty][:, full]
        least[empty] = least[full[np.argmin(order, axis=1)]]
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=U) * _BASE
    for k in range(ROWS):
        key = mix(key * _STEP + rows[:, k])
    return key.view(np.int64)


def digest(found: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set."""
    return tuple(
        int(mix(found + s).sum(dtype=U).astype(np.int64)) for s in (_BASE, _INVERSE)
    )
