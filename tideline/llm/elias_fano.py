"""Elias-Fano sequences and an n-gram trie over them, in one memory-mapped file."""

from __future__ import annotations

import io

import numpy as np

U64 = np.uint64
#: Bits of a successor inside its context.
SUCC_BITS = 30
#: The position of the k-th set bit of each octet.
_NTH = np.array([[*(j for j in range(8) if o >> j & 1), *[0] * 8][:8] for o in range(256)], dtype=np.int64)


def _pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, packed; one spare word at the end."""
    n = len(values)
    out = np.zeros((n * width + 63) // 64 + 2, dtype=U64)
    if width and n:
        low = values & U64((1 << width) - 1)
        at = np.arange(n, dtype=np.int64) * width
        word, bit = at >> 6, (at & 63).astype(U64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] |= np.bitwise_or.reduceat(low << bit, first)
        over = np.flatnonzero(bit.astype(np.int64) + width > 64)
        out[word[over] + 1] |= low[over] >> (U64(64) - bit[over])
    return out


class EliasFano:
    """A non-decreasing sequence: packed low bits, and high parts in unary with counts of zeros and ones before each word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        upper = (values >> U64(width)).astype(np.int64) if n else np.zeros(0, np.int64)
        size = n + (top >> width) + 2
        bits = np.zeros((size + 63) // 64 * 64, dtype=np.uint8)
        bits[upper + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(U64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype(np.uint32 if size < 1 << 31 else U64)
        return cls(n, width, _pack_low(values, width), high, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros]

    @staticmethod
    def _nth(words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The position of the ``k``-th set bit, from 0, of each word; 64 if it has fewer."""
        octets = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.uint8)
        octet = (upto <= k[:, None]).sum(axis=1)
        inside = np.minimum(octet, 7)
        row = np.arange(len(octets))
        rest = k - np.where(octet > 0, upto[row, np.maximum(inside - 1, 0)], 0)
        return np.where(octet < 8, octet * 8 + _NTH[octets[row, inside], np.clip(rest, 0, 7)], 64)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """The position of the ``k``-th zero, from 0."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word.astype(np.int64) * 64 + self._nth(~self.high[np.minimum(word, len(self.high) - 1)], k - self.zeros[word].astype(np.int64))

    def _rank_range(self, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The indices of the elements whose high part is ``upper``: [first, last)."""
        first = np.where(upper > 0, self._select0(np.maximum(upper - 1, 0)) + 1 - upper, 0)
        return first, self._select0(upper) - upper

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=U64)
        at = i.astype(np.int64) * self.width
        word, bit = at >> 6, (at & 63).astype(U64)
        high = np.where(bit > 0, self.low[word + 1] << ((U64(64) - bit) & U64(63)), U64(0))
        return ((self.low[word] >> bit) | high) & U64((1 << self.width) - 1)

    def find(self, x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Successor search: the index of the first element >= ``x`` inside x's high part, and whether it equals ``x``.
        With ``low`` and ``high``, only indices of [low, high) are searched."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        top = len(self.high) * 64 - self.n - 1
        upper = np.minimum((x >> U64(self.width)).astype(np.int64), top)
        lo, end = self._rank_range(upper)
        if low is not None:
            lo, end = np.maximum(lo, low), np.minimum(end, high)
        want, hi = x & U64((1 << self.width) - 1), np.maximum(end, lo)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = (lo < hi) & (self.low_bits(np.minimum(mid, self.n - 1)) < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.minimum(mid, hi))
        inside = lo < end
        return lo, inside & (self.low_bits(np.minimum(lo, self.n - 1)) == want) & ((x >> U64(self.width)).astype(np.int64) == upper)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Element ``i``: select over the ones."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros.astype(np.int64)
        word = np.searchsorted(ones, i, side="right") - 1
        at = word * 64 + self._nth(self.high[np.minimum(word, len(self.high) - 1)], i - ones[word])
        return ((at - i).astype(U64) << U64(self.width)) | self.low_bits(i)

    def values(self) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little")
        upper = np.flatnonzero(bits) - np.arange(self.n)
        return (upper.astype(U64) << U64(self.width)) | self.low_bits(np.arange(self.n))


class Level:
    """The n-grams of one order: contexts, monotone pointers to their successors, successors and quantised log10 values.

    Successors rise inside a context; the largest successor of the contexts before is added to each, which makes the whole
    sequence monotone. A search reads the context's range from the pointers, adds that base and looks inside the range.
    """

    STEP = 16 / 65_535  # log10 of 0 to 16 in 16 bits

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, log10: np.ndarray) -> Level:
        """From distinct pairs sorted by context and successor (of SUCC_BITS bits); values from 0 to 16."""
        new = np.concatenate([[True], context[1:] != context[:-1]]) if len(context) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(context)) - 1
        base = np.concatenate([[U64(0)], np.cumsum(successor[last] + U64(1), dtype=U64)[:-1]]) if len(first) else np.zeros(0, U64)
        rising = successor + np.repeat(base, last - first + 1)
        codes = np.clip(np.rint(log10 / cls.STEP), 0, 65_535).astype(np.uint16)
        return cls(EliasFano.build(context[new]), EliasFano.build(np.append(first, len(context)).astype(U64)), EliasFano.build(rising), codes)

    def ranges(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(low, high, base)`` of the successors of each context; an unknown context has an empty range."""
        if not self.contexts.n:
            none = np.zeros(len(context), np.int64)
            return none, none, none.astype(U64)
        rank, known = self.contexts.find(context)
        rank = np.where(known, rank, 0)
        low, high = self.pointers.get(rank).astype(np.int64), self.pointers.get(rank + 1).astype(np.int64)
        base = np.where(low > 0, self.successors.get(np.maximum(low - 1, 0)) + U64(1), U64(0))
        return low, np.where(known, high, low), base

    def lookup(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The values of pairs that are sorted by context; -1 for pairs that are not in the level."""
        out = np.full(len(context), -1.0)
        if not len(context) or not self.contexts.n:
            return out
        new = np.concatenate([[True], context[1:] != context[:-1]])
        low, high, base = (v[np.cumsum(new) - 1] for v in self.ranges(context[new]))
        at, hit = self.successors.find(successor + base, low, high)
        out[hit] = self.codes[at[hit]].astype(np.float64) * self.STEP
        return out


class Trie:
    """Levels of several orders in one file; ``map`` opens them from memory-mapped bytes, which the page cache holds."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def dump(self) -> bytes:
        """All levels behind a table of contents."""
        body, toc = io.BytesIO(), []

        def put(a: np.ndarray) -> None:
            body.write(b"\0" * (-body.tell() % 8))
            toc.append((body.tell(), len(a), {"<u8": 0, "<u4": 1, "<u2": 2}[a.dtype.str]))
            body.write(a.tobytes())

        heads = []
        for level in self.levels:
            for part in (level.contexts, level.pointers, level.successors):
                heads.append((part.n, part.width, 0))
                for a in part.arrays():
                    put(a)
            put(level.codes)
        table = np.array([(len(self.levels), 0, 0), *heads, *toc], dtype=np.int64)
        return len(table).to_bytes(8, "little") + table.tobytes() + body.getvalue()

    @classmethod
    def map(cls, raw: np.ndarray) -> Trie:
        rows = int(raw[:8].view(np.int64)[0])
        table = raw[8 : 8 + 24 * rows].view(np.int64).reshape(-1, 3)
        body, n = raw[8 + 24 * rows :], int(table[0, 0])
        heads, toc = table[1 : 1 + 3 * n], iter(table[1 + 3 * n :])

        def view() -> np.ndarray:
            at, size, kind = map(int, next(toc))
            kind = np.dtype(["<u8", "<u4", "<u2"][kind])
            return body[at : at + size * kind.itemsize].view(kind)

        levels = []
        for k in range(n):
            parts = [EliasFano(int(heads[3 * k + j, 0]), int(heads[3 * k + j, 1]), view(), view(), view()) for j in range(3)]
            levels.append(Level(*parts, view()))
        return cls(levels)
