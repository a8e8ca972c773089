"""Elias-Fano coding of monotone sequences in numpy: about 2 + log2(universe / n) bits a value, with random access."""

from __future__ import annotations

import numpy as np

#: Bits of the upper part between two stored counts of ones.
_BLOCK = 512
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)
#: Place of the k-th one in a byte, for each byte and k.
_SELECT = np.array([[([i for i in range(8) if x >> i & 1] + [8] * 8)[k] for k in range(8)] for x in range(256)], np.uint8)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays low, high, ones of the non-decreasing values below `universe`; decode with Sequence."""
    n = len(values)
    width = width_of(n, universe)
    values = values.astype(np.uint64)
    low = np.zeros(0, np.uint8)
    if width and n:
        bits = []
        for at in range(0, n, 1 << 19):  # a multiple of 8 values, so that parts end at whole bytes
            part = values[at : at + (1 << 19)]
            bits.append(np.packbits(((part[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        low = np.concatenate(bits)
    place = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    size = -(-((int(place[-1]) if n else 0) + 1) // _BLOCK) * _BLOCK
    marks = np.zeros(size, np.uint8)
    marks[place] = 1
    high = np.packbits(marks, bitorder="little")
    ones = np.concatenate([[0], np.cumsum(marks.reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64))]).astype(np.int64)
    return {"low": np.concatenate([low, np.zeros(8, np.uint8)]), "high": high, "ones": ones}


def width_of(n: int, universe: int) -> int:
    return max(0, (universe // max(1, n)).bit_length() - 1)


class Sequence:
    """Values of an encoded sequence, at given places or all."""

    def __init__(self, arrays: dict[str, np.ndarray], n: int, universe: int):
        self.n, self.width = n, width_of(n, universe)
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.int64)
        words = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        bit = at.astype(np.int64) * self.width
        out = words[bit >> 3] >> (bit & 7).astype(np.uint64)
        return (out & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def all(self) -> np.ndarray:
        at = np.arange(self.n)
        return (np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - at << self.width) + self._low(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where it is not in the sequence; for sequences without repeated values.

        As many zeros as the value's upper part says stand before the ones of that upper part; among these, ascending in
        their lower parts, the value is found by bisection.
        """
        out = np.full(len(values), -1, np.int64)
        for lo in range(0, len(values), 1 << 16):
            self._find(np.asarray(values[lo : lo + (1 << 16)], np.int64), out[lo : lo + (1 << 16)])
        return out

    def _zero(self, rank: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        """Places of the zeros of given ranks in the upper part; `zeros` counts them before each block."""
        block = np.searchsorted(zeros, rank, side="right") - 1
        rest, row = rank - zeros[block], np.arange(len(rank))
        upto = np.cumsum(np.bitwise_count(~np.asarray(self.high).view("<u8").reshape(-1, _BLOCK // 64)[block]), axis=1, dtype=np.int64)
        word = (upto <= rest[:, None]).sum(axis=1)
        rest -= np.where(word > 0, upto[row, word - 1], 0)
        data = ~np.asarray(self.high).reshape(-1, 8)[block * (_BLOCK // 64) + word]
        upto = np.cumsum(_ONES[data], axis=1, dtype=np.int64)
        byte = (upto <= rest[:, None]).sum(axis=1)
        rest -= np.where(byte > 0, upto[row, byte - 1], 0)
        return block * _BLOCK + word * 64 + byte * 8 + _SELECT[data[row, byte], rest]

    def _find(self, values: np.ndarray, out: np.ndarray) -> None:
        zeros = np.arange(len(self.ones)) * _BLOCK - self.ones
        upper = values >> self.width
        todo = np.flatnonzero((values >= 0) & (upper <= zeros[-1]) & (self.n > 0))
        upper, lower = upper[todo], values[todo] & ((1 << self.width) - 1)
        bounds = np.concatenate([upper - 1, upper])
        some = (bounds >= 0) & (bounds < zeros[-1])
        place = np.where(bounds < 0, -1, len(self.high) * 8)
        place[some] = self._zero(bounds[some], zeros)
        low, high = place[: len(todo)] + 1 - upper, np.minimum(place[len(todo) :] - upper, self.n)
        last = high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self._low(middle) < lower[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        there = np.flatnonzero(low < last)
        there = there[self._low(low[there]) == lower[there]]
        out[todo[there]] = low[there]

    def at(self, places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), np.int64)
        for lo in range(0, len(places), 1 << 16):
            out[lo : lo + (1 << 16)] = self._some(np.asarray(places[lo : lo + (1 << 16)], np.int64))
        return out

    def _some(self, places: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.ones, places, side="right") - 1
        rest = places - self.ones[block]
        data = np.asarray(self.high).reshape(-1, _BLOCK // 8)[block]
        upto = np.cumsum(_ONES[data], axis=1, dtype=np.int64)
        byte = (upto <= rest[:, None]).sum(axis=1)
        row = np.arange(len(places))
        within = rest - np.where(byte > 0, upto[row, byte - 1], 0)
        bit = block * _BLOCK + byte * 8 + _SELECT[data[row, byte], within]
        return (bit - places << self.width) + self._low(places)
