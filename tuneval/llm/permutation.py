"""A keyed permutation of the numbers below any size: a Feistel network over the
next power of four, walked until the number lies below the size again."""

from __future__ import annotations

import hashlib
import hmac

ROUNDS = 8


class Permutation:
    def __init__(self, key: bytes, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.key, self.mask = key, (1 << self.half) - 1

    def _mix(self, i: int, x: int) -> int:
        return int.from_bytes(hmac.digest(self.key, b"%d|%d|%d" % (self.size, i, x), hashlib.sha256)[:16]) & self.mask

    def _walk(self, n: int, rounds) -> int:
        while True:
            a, b = n >> self.half, n & self.mask
            for i in rounds:
                a, b = b, a ^ self._mix(i, b)
            n = b << self.half | a           # halves swapped: the same rounds backwards undo it
            if n < self.size:
                return n

    def at(self, n: int) -> int:
        return self._walk(n, range(ROUNDS))

    def back(self, n: int) -> int:
        return self._walk(n, range(ROUNDS - 1, -1, -1))

    def turn(self, n: int) -> int:
        """Another permutation, one that leaves no number in its place (but 0 below 1)."""
        return self.back((self.at(n) + 1) % self.size)
