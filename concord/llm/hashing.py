"""Vectorised hashing of words and rolling windows over Arrow string columns.

All functions work on whole columns at once: the UTF-8 bytes of every text of a
column lie end to end in one buffer, and documents are told apart by offsets.

Words and windows of words are hashed by polynomials modulo the prime 2**61 - 1 whose
bases are drawn at random (Family).  Two different sequences of n values agree
for at most n of the 2**61 bases, whatever the sequences are.  gram_hashes is a faster
polynomial modulo 2**64, for which sequences can be built that agree under every base:
it only chooses places, and never decides that two strings are equal.
"""

from __future__ import annotations

import hashlib
import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_S31, _S30, _S61 = np.uint64(31), np.uint64(30), np.uint64(61)
_M31, _M30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_M64 = (1 << 64) - 1
_LANE = 7  # bytes of a word that make one value
_LANES = 16
_BLOCK = 1 << 14
#: Which bits of eight bytes hold the first 0 to 7 of them.
_KEPT = np.array([(1 << 8 * i) - 1 for i in range(8)], dtype=np.uint64)
#: Space, and tab to carriage return: what separates words.
SEPARATOR = np.isin(np.arange(256), [32, *range(9, 14)])


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit integers modulo 2**61 - 1."""
    x = _folded(x)
    x[x >= _P] -= _P
    return x


def _folded(x: np.ndarray) -> np.ndarray:
    """The same modulo 2**61 - 1, but for at most 7 above 2**61: small enough to go on with."""
    out = x & _P
    out += x >> _S61
    return out


def times(a: np.ndarray, factor: int) -> np.ndarray:
    """a * factor modulo 2**61 - 1, folded; a folded.

    With halves of 30 and 31 bits, 2**62 is 2 and 2**61 is 1, so all parts and their sum fit 64 bits.
    """
    factor %= PRIME
    high, low = np.uint64(factor >> 31), np.uint64(factor & ((1 << 31) - 1))
    a_high, a_low = a >> _S31, a & _M31
    middle = a_high * low
    middle += a_low * high
    a_high *= high << np.uint64(1)
    a_low *= low
    a_low += a_high
    np.right_shift(middle, _S30, out=a_high)
    a_low += a_high
    middle &= _M30
    middle <<= _S31
    a_low += middle
    return _folded(a_low)


def window_hashes(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes below 2**61 - 1 of values[i:i+width] (values below it) for every i that has so many values.

    Windows of twice the width come from two halves, and windows of any width from those of the powers of two in it.
    Done in blocks that stay in the processor's cache.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    step = max(_BLOCK, width)
    for a in range(0, n, step):
        b = min(n, a + step)
        out[a:b] = _window_block(values[a : b + width - 1], width, base)
    return out


def _window_block(values: np.ndarray, width: int, base: int) -> np.ndarray:
    n = len(values) - width + 1
    out, have, part, size = None, 0, values, 1
    while True:
        if width & size:
            if out is None:
                out = part
            else:
                m = min(len(out), len(part) - have)
                out = times(out[:m], pow(base, size, PRIME))
                out += part[have : have + m]
                out = _folded(out)
            have += size
        if have == width:
            return reduced(out[:n])
        doubled = times(part[:-size], pow(base, size, PRIME))
        doubled += part[size:]
        part = _folded(doubled)
        size *= 2


def gram_hashes(data: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hashes of all strings of `width` bytes, from prefix sums modulo 2**64: to choose places by, not to tell strings apart."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, len(data)), out=total[1:])
    out = total[width:] - total[:-width]
    out *= _powers(pow(base, -1, 1 << 64), n)
    return mix64(out)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base & _M64, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


@dataclass(frozen=True)
class Family:
    """Bases of hashes of words and of windows of words."""

    word: int
    window: int

    @classmethod
    def drawn(cls, seed: int | None = None) -> Family:
        """From a seed where results must not change between runs; else from the system's random source."""
        rng = random.SystemRandom() if seed is None else random.Random(seed)
        return cls(rng.randrange(1 << 32, PRIME), rng.randrange(1 << 32, PRIME))

    def windows(self, words: np.ndarray, width: int) -> np.ndarray:
        return window_hashes(words, width, self.window)


#: For hashes that must be the same in every run.
FIXED = Family.drawn(1)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and each row's offset (one more than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # older pyarrow keeps an empty chunked array
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


@dataclass
class Words:
    """The words of a column: byte ranges, and the number of words before each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of documents + 1
    byte_is_word: np.ndarray
    _known: dict[int, np.ndarray] = field(default_factory=dict)  # hashes made before, by base

    def hashes(self, family: Family = FIXED) -> np.ndarray:
        """A hash below 2**61 - 1 of each word: a polynomial of its pieces of 7 bytes and its length; words of over 112 bytes by BLAKE2."""
        known = self._known.get(family.word)
        if known is None:
            known = self._known[family.word] = self._hashed(family.word)
        return known

    def _hashed(self, base: int) -> np.ndarray:
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        values = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        size = self.end - self.start
        out = np.empty(len(size), dtype=np.uint64)
        for a in range(0, len(size), _BLOCK):
            out[a : a + _BLOCK] = self._hashed_block(values, self.start[a : a + _BLOCK], size[a : a + _BLOCK], base)
        for i in np.flatnonzero(size > _LANE * _LANES).tolist():
            raw = hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8, key=base.to_bytes(8, "little")).digest()
            out[i] = int.from_bytes(raw, "little") % PRIME
        return out

    @staticmethod
    def _hashed_block(values: np.ndarray, start: np.ndarray, size: np.ndarray, base: int) -> np.ndarray:
        out = values[start] & _KEPT[np.minimum(size, _LANE)]
        at = np.flatnonzero(size > _LANE)
        for lane in range(1, _LANES):
            if not len(at):
                break
            more = times(out[at], base)
            more += values[start[at] + lane * _LANE] & _KEPT[np.minimum(size[at] - lane * _LANE, _LANE)]
            out[at] = _folded(more)
            at = at[size[at] > (lane + 1) * _LANE]
        out = times(out, base)
        out += size.astype(np.uint64)
        return reduced(out)

    def positions(self) -> np.ndarray:
        """Each word's place in its own document."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.start))


def words_of(column) -> Words:
    """Maximal runs of bytes other than separators, never across documents."""
    data, offs = text_bytes(column)
    word = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    before = np.empty_like(word)
    before[1:] = ~word[:-1]
    before[:1] = True
    start = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty_like(word)
    after[:-1] = ~word[1:]
    after[-1:] = True
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offs), word)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in start .. start+width-1 of any start."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(change)[:n] > 0
