"""Sets of word shingles as 64-bit hashes, for many texts at once in arrays."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def sequence(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed) * _U(1 << 20)) * _MULTIPLIER)


_BYTE_VALUES = sequence(256, 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = _U(0xD1342543DE82EF95)
_INVERSE = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes that are hashed together; a longer text is hashed on its own.
TOGETHER = 1_000_000


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers


def _sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[_LOWER[data]] * power[: len(data)], out=sums[1:])
    word = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MULTIPLIER)
    full = np.empty(0, np.uint64)
    if len(word) >= words:
        full = word[: len(word) - words + 1]
        for j in range(1, words):
            full = mix(full * _MULTIPLIER + word[j : len(word) - words + 1 + j])
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    marks = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)])).tolist()
    out = []
    for lo, hi in zip(marks, marks[1:]):
        if hi - lo >= words:
            out.append(np.unique(full[lo : hi - words + 1]))
        elif hi > lo:
            short = word[lo : lo + 1]
            for j in range(lo + 1, hi):
                short = mix(short * _MULTIPLIER + word[j : j + 1])
            out.append(mix(short + _U(hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of so many words.

    A-Z count as a-z; space and the controls 09 to 0D separate words. With fewer
    words the whole sequence is one shingle; without words the set is empty.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for t in texts:
        b = (t or "").encode()
        if group and held + len(b) > TOGETHER:
            out += _sets(group, words)
            group, held = [], 0
        group.append(b)
        held += len(b) + 1
    return out + (_sets(group, words) if group else [])
