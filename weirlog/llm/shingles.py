"""Word shingles of many texts at once, hashed with prefix polynomials in numpy."""

from __future__ import annotations

import numpy as np

M64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit words."""
    x = (x ^ (x >> M64(30))) * M64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> M64(27))) * M64(0x94D049BB133111EB)
    return x ^ (x >> M64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.concatenate((np.ones(1, M64), np.full(size - 1, b, M64)))) for b in (BASE, _INVERSE))
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of (data[j] + 1) * BASE**j for j < i; h[b] - h[a] times BASE**-a is the hash of data[a:b]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, M64)
    np.cumsum((data.astype(M64) + M64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its text's index) over all texts in order."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    inside = ~SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    h = span_hash(prefix_hash(data), start, end)
    return h, np.searchsorted(begins, start, side="right") - 1


def shingles_of(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by (text, hash): (hash, text's index, times), and two hashes of each text's word sequence.

    A shingle is k words in a row; a text of fewer words has one shingle of all of them, one of none has none.
    """
    w, doc = words_of(texts)
    n = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n)))
    mult = mix(np.arange(1, k + 1, dtype=M64)) | M64(1)
    at = np.flatnonzero(doc[: max(len(doc) - k + 1, 0)] == doc[k - 1 :]) if len(doc) >= k else np.zeros(0, np.int64)
    s = np.zeros(len(at), M64)
    for j in range(k):
        s += w[at + j] * mult[j]
    s, owner = mix(s), doc[at]
    few = np.flatnonzero((n > 0) & (n < k))
    # the sequence's hash is linear in the words' hashes with a multiplier for each place
    place = np.arange(len(w)) - first[doc]
    up, down = powers(int(n.max(initial=0)) + 1)
    one = np.zeros(len(texts), M64)
    two = np.zeros(len(texts), M64)
    np.add.at(one, doc, w * up[place])
    np.add.at(two, doc, mix(w) * down[place])
    s, owner = np.concatenate((s, mix(one[few] + n[few].astype(M64)))), np.concatenate((owner, few))
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.concatenate((at, [len(s)])))
    return s[at], owner[at], times, mix(one + n.astype(M64)), mix(two ^ n.astype(M64))
