"""Sets of hashed five-word shingles of whole texts, made for a block of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_COEFFICIENTS = (_RNG.integers(1, 1 << 63, 64, dtype=np.uint64) << _U(1)) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 19)
            one = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
            self.up, self.down = one(_U(_BASE)), one(_U(_INVERSE))
        return self.up, self.down


_POWERS = _Powers()


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z lower-cased, words by ASCII white space."""
    data = [(t or "").encode().lower() for t in texts]
    raw = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    up, down = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts]) if len(starts) else np.empty(0, np.uint64)
    rows = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rows += words[k : len(words) - WORDS + 1 + k] * _COEFFICIENTS[k] if len(rows) else _U(0)
    rows = mix(rows)
    offsets = np.cumsum([1, *(len(d) + 1 for d in data)])
    bounds = np.searchsorted(starts, offsets)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            yield np.unique(rows[a : b - WORDS + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * _COEFFICIENTS[8 : 8 + b - a]).sum(dtype=np.uint64) + _U(b - a)], np.uint64))
        else:
            yield np.empty(0, np.uint64)
