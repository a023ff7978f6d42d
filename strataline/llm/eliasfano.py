"""Elias-Fano coding of a non-decreasing sequence, with select.

n values up to u take n * floor(log2(u / n)) low bits and at most 2n + 1 high bits: each value's high part in unary,
value k at bit high(k) + k. select(k) jumps to a stored sample of every 256th one and counts bits from there; select_many
does so for a run of ascending places, each sample's bits once.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
_HEAD = struct.Struct("<QQBII")


def encode(values: np.ndarray) -> bytes:
    v = np.asarray(values, np.uint64)
    n, u = len(v), int(v[-1]) if len(v) else 0
    low_bits = max(0, (u // n).bit_length() - 1) if n else 0
    high = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(high[-1]) + 1 if n else 0), np.uint8)
    bits[high] = 1
    upper = np.packbits(bits, bitorder="little").tobytes()
    low = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    lower = np.packbits(low.reshape(-1), bitorder="little").tobytes()
    samples = high[::STEP].astype("<u8").tobytes()
    return _HEAD.pack(n, u, low_bits, len(upper), len(lower)) + samples + upper + lower


class EliasFano:
    """Reads what encode() wrote; decodes nothing but what is asked for."""

    def __init__(self, raw: bytes, at: int = 0):
        self.n, self.u, self.low_bits, upper, lower = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        k = -(-self.n // STEP)
        self.samples = np.frombuffer(raw, "<u8", k, at)
        self.upper = np.frombuffer(raw, np.uint8, upper, at + 8 * k)
        self.lower = np.frombuffer(raw, np.uint8, lower, at + 8 * k + upper)
        self.size = _HEAD.size + 8 * k + upper + lower

    def select(self, k: int) -> int:
        """Value k, from 0."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        pos, left = int(self.samples[k // STEP]), k % STEP
        if left:
            byte = pos // 8
            seen = -int(np.unpackbits(self.upper[byte : byte + 1], bitorder="little")[: pos % 8].sum()) - 1
            while True:
                ones = np.flatnonzero(np.unpackbits(self.upper[byte : byte + 64], bitorder="little"))
                if seen + len(ones) >= left:
                    pos = byte * 8 + int(ones[left - seen - 1])
                    break
                seen, byte = seen + len(ones), byte + 64
        low = 0
        for b in range(self.low_bits):
            at = k * self.low_bits + b
            low |= ((int(self.lower[at >> 3]) >> (at & 7)) & 1) << b
        return ((pos - k) << self.low_bits) | low

    def select_many(self, places: np.ndarray) -> np.ndarray:
        """The values at ascending places."""
        k = np.asarray(places, np.int64)
        if len(k) and not (0 <= k[0] and k[-1] < self.n):
            raise IndexError(k)
        ends = np.append(self.samples[1:], np.uint64(8 * len(self.upper))).astype(np.int64)
        pos = np.zeros(len(k), np.int64)
        cuts = np.flatnonzero(np.diff(k // STEP, prepend=-1))
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(k)]):
            j = int(k[x]) // STEP
            first = int(self.samples[j]) // 8
            ones = np.flatnonzero(np.unpackbits(self.upper[first : int(ends[j]) // 8 + 1], bitorder="little"))
            ones = ones[np.searchsorted(ones, int(self.samples[j]) - 8 * first) :]
            pos[x:y] = 8 * first + ones[k[x:y] - j * STEP]
        low = np.zeros(len(k), np.uint64)
        for b in range(self.low_bits):
            at = k * self.low_bits + b
            low |= ((self.lower[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return ((pos - k).astype(np.uint64) << np.uint64(self.low_bits)) | low

    def all(self) -> np.ndarray:
        """Every value."""
        pos = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        low = np.unpackbits(self.lower, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits) if self.low_bits else np.zeros((self.n, 0), np.uint8)
        return ((pos - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
