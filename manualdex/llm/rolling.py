"""Hashes of any stretch of a sequence of codes, from prefix sums of a polynomial, in numpy."""

from __future__ import annotations

import numpy as np

from manualdex.llm.grams import U, mix

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Powers kept between calls.
_KEPT = 1 << 21


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 12), U(base))
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if len(known) <= _KEPT:
            _powers[base] = known
    return known[:n]


class Stretches:
    """Hashes of stretches ``[a, b)`` of one array of 64-bit codes. Equal stretches have equal hashes."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(_BASE, n), out=self.total[1:])
        self.down = powers(_INVERSE, n + 1)

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The polynomial of each stretch as if it began at place 0, so that ``joined`` can append to it."""
        return (self.total[b] - self.total[a]) * self.down[a]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.raw(a, b))


def joined(raw: np.ndarray, length: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The polynomial of a stretch of ``length`` codes followed by the stretch of polynomial ``more``."""
    return raw + powers(_BASE, int(length.max()) + 1 if len(length) else 1)[length] * more


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of each member, and its place in the group from 0."""
    group = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return group, np.arange(len(group)) - np.repeat(ends - counts, counts)
