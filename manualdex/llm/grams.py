"""Word and shingle hashes of Arrow text columns, in numpy and without a Python string per word.

Texts are taken in slices of a few megabytes straight from Arrow's UTF-8 buffer. A word's 64-bit hash
is the difference of two prefix sums of a polynomial over its bytes, so all words of a slice are
hashed at once; a shingle's hash mixes the hashes of its words with their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is a slice of its own.
SLICE = 1 << 21

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes that part words: the six ASCII white-space characters.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: Bytes that part words when punctuation does too: all ASCII that is neither letter nor digit.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n, kept for slices of the usual size."""
    known = _powers.get(name)
    if known is not None and len(known) >= n:
        return known[:n]
    steps = np.full(max(n, SLICE + 1), U(base))
    steps[0] = 1
    made = np.multiply.accumulate(steps)
    if n <= SLICE + 1:
        _powers[name] = made
    return made[:n]


@dataclass
class Words:
    """The words of some whole texts. ``first[d]:first[d + 1]`` are the words of text d."""

    first: np.ndarray
    hashes: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.first))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words, in order, and the first index of each text in them.

        A text with fewer words than n, but one at least, has its whole sequence as one shingle.
        """
        counts = np.diff(self.first)
        full = np.maximum(counts - n + 1, 0)
        made = np.where(full > 0, full, (counts > 0).astype(np.int64))
        out_first = np.concatenate(([0], np.cumsum(made)))
        out = np.empty(out_first[-1], np.uint64)
        if len(self.hashes) >= n:
            h = np.zeros(len(self.hashes) - n + 1, np.uint64)
            for k in range(n):
                h += self.hashes[k : k + len(h)] * _PLACE[k]
            h = mix(h)
            starts = np.repeat(self.first[:-1], full) + _within(full)
            places = np.repeat(out_first[:-1], full) + _within(full)
            out[places] = h[starts]
        for size in range(1, n):
            short = np.flatnonzero(counts == size)
            if len(short):
                h = np.full(len(short), U(size))
                for k in range(size):
                    h += self.hashes[self.first[short] + k] * _PLACE[k]
                out[out_first[short]] = mix(h)
        return out, out_first


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, … up to each count, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def words(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray = SPACES) -> Words:
    """Words of the texts ``data[offsets[d]:offsets[d + 1]]``, lower-cased A-Z, parted by ``parting``."""
    n = len(data)
    if n == 0:
        return Words(np.zeros(len(offsets), np.int64), np.empty(0, np.uint64))
    gap = parting[data]
    before = np.empty(n, bool)
    before[1:] = gap[:-1]
    after = np.empty(n, bool)
    after[:-1] = gap[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[LOWER[data]] * _power("up", _BASE, n), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power("down", _INVERSE, n)[starts])
    return Words(np.searchsorted(starts, offsets).astype(np.int64), hashes)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, ends, chars = texts.buffers()
    if ends is None or len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(chars, np.uint8) if chars is not None else np.empty(0, np.uint8)
    return data, offsets.astype(np.int64)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, bytes, offsets)`` of whole texts, about ``SLICE`` bytes at once."""
    data, offsets = buffers(texts)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
