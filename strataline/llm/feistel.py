"""Keyed permutations of {0, ..., n - 1} without fixed points, from a Feistel network with cycle walking.

F is a balanced Feistel network over the least even number of bits that holds n, walked until it lands below n again;
the permutation used is x -> F^-1(F(x) + 1 mod n): a bijection that moves every value (n > 1), with the key needed both ways.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

ROUNDS = 8


class Permutation:
    def __init__(self, key: bytes, tweak: bytes, n: int):
        self.n, self.key, self.tweak = n, blake2b(key, digest_size=32).digest(), tweak
        self.half = max(1, -(-(n - 1).bit_length() // 2)) if n > 1 else 1
        self.mask = (1 << self.half) - 1

    def _round(self, r: int, v: int) -> int:
        size = -(-self.half // 8)
        out = blake2b(r.to_bytes(1, "big") + v.to_bytes(size, "big") + self.tweak, key=self.key, digest_size=min(64, size))
        return int.from_bytes(out.digest(), "big") & self.mask

    def _once(self, x: int, rounds) -> int:
        left, right = x >> self.half, x & self.mask
        for r in rounds:
            left, right = right, left ^ self._round(r, right)
        return right << self.half | left  # so that the rounds backwards undo it

    def _walk(self, x: int, rounds) -> int:
        x = self._once(x, rounds)
        while x >= self.n:
            x = self._once(x, rounds)
        return x

    def _step(self, x: int, by: int) -> int:
        if self.n < 2:
            return x
        y = (self._walk(x, range(ROUNDS)) + by) % self.n
        return self._walk(y, range(ROUNDS - 1, -1, -1))

    def forward(self, x: int) -> int:
        return self._step(x, 1)

    def back(self, x: int) -> int:
        return self._step(x, -1)


def permute_digits(key: bytes, tweak: bytes, radices: list[int], values: list[int], back: bool = False, within: Callable[[list[int]], bool] | None = None) -> list[int]:
    """A number in mixed radix, permuted; same radices out as in. With `within`, walked on until that holds: a permutation
    of the numbers for which it does."""
    n, x = 1, 0
    for r, v in zip(radices, values, strict=True):
        n, x = n * r, x * r + v
    p = Permutation(key, tweak + b"|" + b",".join(b"%d" % r for r in radices), n)
    while True:
        x = rest = p.back(x) if back else p.forward(x)
        out = []
        for r in reversed(radices):
            rest, d = divmod(rest, r)
            out.append(d)
        out.reverse()
        if within is None or within(out):
            return out
