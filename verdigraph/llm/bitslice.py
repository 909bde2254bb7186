"""Bit-sliced Hamming comparison of many fingerprints at once.

Plane ``b`` holds bit ``b`` of 64 fingerprints in each machine word. Comparing one fingerprint with
64 others is then one XOR a plane, and the 64 running distances are kept as vertical counters: two
planes at a time go through a full adder (carry-save), so no distance is ever written out. Every few
planes, words in which all 64 distances exceed the radius are abandoned.
"""

from __future__ import annotations

import numpy as np

#: Planes added between two looks for words to abandon, and rows compared at a time.
STRIDE, ROWS = 8, 512

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes (bits x words) of fingerprints given as an (n x m) array of 64-bit words."""
    n, m = prints.shape
    width = -(-n // 64) * 64
    bits = np.zeros((64 * m, width), "u1")
    bits[:, :n] = np.unpackbits(np.ascontiguousarray(prints, "<u8").view("u1").reshape(n, 8 * m), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


class Counter:
    """Vertical saturating counters, one a bit of each word."""

    def __init__(self, size: int, radius: int):
        self.radius = radius
        self.bits = [np.zeros(size, "<u8") for _ in range(max(1, (radius + 1).bit_length()))]
        self.over = np.zeros(size, "<u8")

    def _carry(self, carry: np.ndarray, at: int) -> None:
        for k in range(at, len(self.bits)):
            self.bits[k], carry = self.bits[k] ^ carry, self.bits[k] & carry
        self.over |= carry

    def add_two(self, a: np.ndarray, b: np.ndarray) -> None:
        """Full adder: the lowest counter plane and two new planes give a sum and one carry."""
        low = self.bits[0]
        part = low ^ a
        carry = (low & a) | (part & b)
        self.bits[0] = part ^ b
        self._carry(carry, 1)

    def exceeded(self) -> np.ndarray:
        """Marks distances above the radius: compares the counters with it from the top plane down."""
        above, equal = self.over.copy(), ~self.over
        for k in reversed(range(len(self.bits))):
            if self.radius >> k & 1:
                equal &= self.bits[k]
            else:
                above |= equal & self.bits[k]
                equal &= ~self.bits[k]
        return above

    def keep(self, alive: np.ndarray) -> None:
        self.bits = [b[alive] for b in self.bits]
        self.over = self.over[alive]


def near_pairs(prints: np.ndarray, radius: int):
    """Yields (i, j) index arrays, i < j, of all pairs at most ``radius`` bits apart."""
    n, m = prints.shape
    if n < 2:
        return
    plane = planes(prints)
    words = plane.shape[1]
    order = [64 * w + b for b in range(64) for w in range(m)]
    last = _ONES >> np.uint64(words * 64 - n)
    for top in range(0, n - 1, ROWS):
        rows = np.arange(top, min(top + ROWS, n - 1))
        spans = words - rows // 64
        row = np.repeat(rows, spans)
        word = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(rows // 64, spans)
        valid = np.where(word == words - 1, last, _ONES)
        inside = (row % 64).astype("<u8")
        valid = np.where(word == row // 64, valid & ~(_ONES >> (np.uint64(63) - inside)), valid)
        live = valid != 0
        row, word, valid = row[live], word[live], valid[live]
        counter = Counter(len(row), radius)
        for step in range(0, len(order), 2):
            if not len(row):
                break
            a, b = order[step], order[step + 1]
            counter.add_two(*(plane[p][word] ^ (np.uint64(0) - (prints[row, p // 64] >> np.uint64(p % 64) & np.uint64(1))) for p in (a, b)))
            if step % STRIDE == STRIDE - 2 or step == len(order) - 2:
                valid = valid & ~counter.exceeded()
                alive = valid != 0
                if not alive.all():
                    row, word, valid = row[alive], word[alive], valid[alive]
                    counter.keep(alive)
        if len(row):
            hit, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(valid, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little"))
            yield row[hit], word[hit] * 64 + bit


def forest(n: int, pairs) -> np.ndarray:
    """Smallest index connected to each of ``n`` by the pair arrays of ``pairs``."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(label, np.maximum(a, b), low)
            while True:
                shorter = label[label]
                if (shorter == label).all():
                    break
                label = shorter
    return label
