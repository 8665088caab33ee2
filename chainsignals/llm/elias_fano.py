"""Elias-Fano coding of non-decreasing integer sequences (Elias 1974, Fano 1971).

Of each value the low ``l`` bits are packed one after another; the rest goes to a
unary bit vector with one set bit per value.  Select reads one value from about
``2 + l`` bits per value without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

#: Values between two stored positions of the upper bit vector.
SAMPLE = 256
_HEAD = struct.Struct("<qQQBxxxII")


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing int64 sequence; the first value is the base."""
    values = np.asarray(values, np.int64)
    n = len(values)
    if (values[1:] < values[:-1]).any():
        raise ValueError("values must not decrease")
    base = int(values[0]) if n else 0
    # modulo 2^64, so that values at both ends of the range keep their distance
    v = values.view(np.uint64) - np.uint64(base % 2**64)
    top = int(v[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    lows = np.empty((n, low), np.uint8)
    for bit in range(low):
        lows[:, bit] = (v >> np.uint64(bit)) & np.uint64(1)
    low_bytes = np.packbits(lows.reshape(-1), bitorder="little").tobytes()
    where = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(where[-1]) + 1 if n else 0, np.uint8)
    upper[where] = 1
    upper_bytes = np.packbits(upper, bitorder="little").tobytes()
    samples = where[::SAMPLE].astype("<u4").tobytes()
    return _HEAD.pack(base, n, top, low, len(low_bytes), len(upper_bytes)) + low_bytes + upper_bytes + samples


class EliasFano:
    """Reads values back; ``select(i)`` touches only the bits of value ``i``."""

    def __init__(self, raw: bytes | memoryview):
        raw = memoryview(raw)
        self.base, self.n, self.top, self.low, a, b = _HEAD.unpack(raw[: _HEAD.size])
        at = _HEAD.size
        self.lows, self.upper = raw[at : at + a], raw[at + a : at + a + b]
        self.samples = np.frombuffer(raw[at + a + b : at + a + b + 4 * -(-self.n // SAMPLE)], "<u4")
        self.nbytes = at + a + b + self.samples.nbytes

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word, shift = self.upper[byte] >> (at % 8), at % 8
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte, shift = byte + 1, 0
            word = self.upper[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + shift + ((word & -word).bit_length() - 1)
        low = 0
        if self.low:
            bit = i * self.low
            end = (bit + self.low + 7) // 8
            low = (int.from_bytes(self.lows[bit // 8 : end], "little") >> (bit % 8)) & ((1 << self.low) - 1)
        return self.base + ((place - i) << self.low | low)

    def select_many(self, at: np.ndarray) -> np.ndarray:
        """``select`` of many places: each sample's stretch of the bit vector is read if one of them lies in it."""
        at = np.asarray(at, np.int64)
        if not len(at):
            return np.zeros(0, np.int64)
        if not 0 <= at.min() <= at.max() < self.n:
            raise IndexError(at)
        upper, lows = np.frombuffer(self.upper, np.uint8), np.frombuffer(self.lows, np.uint8)
        block, place = at // SAMPLE, np.empty(len(at), np.int64)
        order = np.argsort(block, kind="stable")
        used, first = np.unique(block[order], return_index=True)
        for b, mine in zip(used.tolist(), np.split(order, first[1:]), strict=True):
            begin = int(self.samples[b])
            end = int(self.samples[b + 1]) if b + 1 < len(self.samples) else 8 * len(upper)
            ones = np.flatnonzero(np.unpackbits(upper[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :])
            place[mine] = begin + ones[at[mine] - b * SAMPLE]
        v = (place - at).astype(np.uint64) << np.uint64(self.low)
        for bit in range(self.low):
            where = at * self.low + bit
            v |= (lows[where // 8] >> (where % 8).astype(np.uint8) & 1).astype(np.uint64) << np.uint64(bit)
        return (v + np.uint64(self.base % 2**64)).view(np.int64)

    def rank(self, value: int) -> int:
        """How many values are smaller, by binary search over ``select``."""
        at, end = 0, self.n
        while at < end:
            middle = (at + end) // 2
            at, end = (middle + 1, end) if self.select(middle) < value else (at, middle)
        return at

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.upper, np.uint8), bitorder="little"))[: self.n]
        v = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if self.low and self.n:
            bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little", count=self.n * self.low).reshape(self.n, self.low)
            for bit in range(self.low):
                v |= bits[:, bit].astype(np.uint64) << np.uint64(bit)
        return (v + np.uint64(self.base % 2**64)).view(np.int64)
