"""Vectorised hashes of the words of a batch of texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(20240607).integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
#: Bytes up to which words are hashed side by side; a longer one is hashed by itself, all its bytes at once.
SIDE_BY_SIDE = 256
#: White space of the contracts: bytes 9 to 13 and 32.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of several texts: their bytes, and where each text's words begin in the arrays."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n + 1 offsets

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space."""
        a, b = self.start[i:j].tolist(), self.end[i:j].tolist()
        raw = self.raw
        return b" ".join(raw[x:y].tobytes() for x, y in zip(a, b, strict=True))


def _polynomial(raw: np.ndarray) -> np.uint64:
    """What the steps acc * _MULTIPLY + _RANDOM[byte] over all bytes come to, block by block of bounded size."""
    acc = np.uint64(0)
    for a in range(0, len(raw), 1 << 16):
        part = raw[a : a + (1 << 16)]
        powers = np.full(len(part) + 1, _MULTIPLY, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        with np.errstate(over="ignore"):
            acc = acc * powers[-1] + (_RANDOM[part] * powers[-2::-1]).sum(dtype=np.uint64)
    return acc


def words_of(texts: list[bytes], fold: bool = False, breaks: np.ndarray = SPACE) -> Words:
    """Splits at the bytes of `breaks`; fold: A-Z are lower-cased."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if fold:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    out = ~breaks[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    size = end - start
    value = np.zeros(len(start), dtype=np.uint64)
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -SIDE_BY_SIDE) :]
    at, lengths = start[order], size[order]
    acc = np.zeros(len(order), dtype=np.uint64)
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    for k in range(longest):  # one character of all words that have it
        m = alive[k]
        acc[:m] = acc[:m] * _MULTIPLY + _RANDOM[raw[at[:m] + k]]
    value[order] = acc
    for i in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
        value[i] = _polynomial(raw[start[i] : end[i]])
    value = mix(value)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return Words(raw, start, end, value, np.searchsorted(start, bounds))


def runs(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values (over text borders too; callers leave those out)."""
    if len(values) < n:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(len(values) - n + 1, dtype=np.uint64)
    for k in range(n):
        acc = acc * _MULTIPLY + values[k : len(values) - n + 1 + k]
    return mix(acc)


def runs_at(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place in `at`; places run past the end at the last value (callers leave those out)."""
    acc = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        acc = acc * _MULTIPLY + values[np.minimum(at + k, len(values) - 1)]
    return mix(acc ^ np.uint64(n))
