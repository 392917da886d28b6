"""Prefix-free parsing of byte texts: phrases between triggers of a rolling hash, overlapping by a window.

The trigger of a window of ``WINDOW`` bytes is the place, among its first ``WINDOW - CORE + 1``, where the rolling hash of
the next ``GRAM`` bytes is smallest: it depends on the window's bytes alone, so equal windows have equal triggers.
The windows of one trigger start side by side; together they are a phrase, and each window lies in one
phrase whole. All of them hold the phrase's core, the ``CORE`` bytes from the trigger on.
"""

from __future__ import annotations

import numpy as np

from .shingles import _BASE, _INVERSE, _U, _Powers, mix

WINDOW, CORE, GRAM = 200, 50, 16
REACH = WINDOW - CORE + 1
#: Bytes that are parsed at a time; stretches overlap by a window, so places fit beside the hash's upper bits.
STRETCH = 1 << 22
_POSITION = _U((1 << 24) - 1)
_RNG = np.random.default_rng(20240301)
_TABLES = [(_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << _U(1)) | _U(1) for _ in range(2)]
_POWERS = _Powers()


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours from a place on; the last width - 1 places are left out."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Block:
    """Some texts' bytes in a row, with the sums that give the hash of any stretch of them."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.up, self.down = _POWERS.upto(len(self.raw) + 1)
        self.sums: dict[int, np.ndarray] = {}

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        if which not in self.sums:
            sums = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum(_TABLES[which][self.raw] * self.up[: len(self.raw)], out=sums[1:])
            self.sums[which] = sums
        sums = self.sums[which]
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def _triggers(self, start: int, end: int) -> np.ndarray:
        """The trigger of each window that lies between two places."""
        place = np.arange(start, end - GRAM + 1)
        rolling = self.hashes(place, place + GRAM)
        rolling = (rolling & ~_POSITION) | (place - start).astype(np.uint64)
        return (sliding_min(rolling, REACH) & _POSITION).astype(np.int64)[: end - start - WINDOW + 1] + start

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each phrase: its document, the first and the last start of its windows, and its trigger."""
        n = len(self.raw)
        if n < WINDOW:
            return (np.empty(0, np.int64),) * 4
        trigger = np.concatenate([self._triggers(a, min(n, a + STRETCH + WINDOW - 1)) for a in range(0, n - WINDOW + 1, STRETCH)])
        room = np.maximum(0, self.lengths - WINDOW + 1)
        doc = np.repeat(np.arange(len(room)), room)
        starts = np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room) + self.offsets[doc]
        t = trigger[starts]
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])])) if len(t) else np.empty(0, np.int64)
        last = np.concatenate([first[1:], [len(t)]])[: len(first)] - 1
        return doc[first], starts[first], starts[last], t[first]
