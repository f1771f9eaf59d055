"""Compact monotone sequences and the n-gram trie levels made of them, in numpy."""

from __future__ import annotations

import struct

import numpy as np

#: Zeros before each byte's n-th zero: position of the n-th zero bit of every byte value.
_ZERO_AT = np.array([[p[n] if n < len(p) else 8 for n in range(8)] for p in ([b for b in range(8) if not v >> b & 1] for v in range(256))], np.uint8)
_ZEROS = np.array([8 - v.bit_count() for v in range(256)], np.int64)


class EliasFano:
    """A non-decreasing sequence: low bits in whole bytes, high parts in unary with a zero directory."""

    def __init__(self, low: np.ndarray, high: np.ndarray, shift: int, n: int):
        self.low, self.high, self.shift, self.n = low, high, shift, n
        self.zeros = np.concatenate(([0], np.cumsum(_ZEROS[high])))

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        shift = next((s for s in (0, 8, 16, 32) if top >> s <= 4 * n + 8), 48)
        kind = {0: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32, 48: np.uint64}[shift]
        low = (values & ((1 << shift) - 1)).astype(kind) if shift else np.zeros(0, kind)
        ones = (values >> shift) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 2 if n else 1, bool)
        bits[ones] = True
        high = np.packbits(bits, bitorder="little")
        return cls(low, np.append(high, np.zeros(1, np.uint8)), shift, n)

    def zero_at(self, k: np.ndarray) -> np.ndarray:
        """Bit position of the k-th zero (from 0); past the end, the end."""
        k = np.minimum(k, self.zeros[-1] - 1)
        byte = np.searchsorted(self.zeros, k, "right") - 1
        return byte * 8 + _ZERO_AT[self.high[byte], k - self.zeros[byte]]

    def one_at(self, k: np.ndarray) -> np.ndarray:
        """Bit position of the k-th one (from 0)."""
        ones = np.arange(len(self.zeros)) * 8 - self.zeros
        byte = np.searchsorted(ones, k, "right") - 1
        return byte * 8 + _ZERO_AT[~self.high[byte], k - ones[byte]]

    def get(self, k: np.ndarray) -> np.ndarray:
        high = self.one_at(k) - k
        return (high << self.shift) | self.low[k].astype(np.int64) if self.shift else high

    def before(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``bucket``."""
        count = np.where(bucket > 0, self.zero_at(np.maximum(bucket - 1, 0)) - (bucket - 1), 0)
        return np.where(bucket > self.zeros[-1], self.n, count)

    def find(self, x: np.ndarray) -> np.ndarray:
        """First index whose value is at least x; ``n`` if there is none."""
        bucket = x >> self.shift
        first = self.before(bucket)
        if not self.shift:
            return first
        end = self.before(bucket + 1)
        rest, at = x & ((1 << self.shift) - 1), first.copy()
        going = np.flatnonzero(at < end)
        while len(going):
            going = going[self.low[at[going]] < rest[going]]
            at[going] += 1
            going = going[at[going] < end[going]]
        return at

    def dump(self) -> bytes:
        head = struct.pack("<qqqq", self.n, self.shift, self.low.nbytes, self.high.nbytes)
        return head + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, buffer: memoryview, at: int) -> tuple[EliasFano, int]:
        """Views into the buffer: nothing is copied but the directory that is computed from them."""
        n, shift, low, high = struct.unpack_from("<qqqq", buffer, at)
        kind = {0: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32, 48: np.uint64}[shift]
        at += 32
        view = lambda k, size, a: np.frombuffer(buffer, k, size // np.dtype(k).itemsize, a)
        return cls(view(kind, low, at), view(np.uint8, high, at + low), shift, n), at + low + high


def quantise(p: np.ndarray, floor: float = 1e-7) -> np.ndarray:
    """Probabilities as one byte each, even steps of the logarithm from ``floor`` to 1."""
    return np.round(np.log(np.clip(p, floor, 1)) / np.log(floor) * 255).astype(np.uint8)


LEVELS = np.exp(np.arange(256) / 255 * np.log(1e-7))


class Level:
    """Children of contexts: their ids, made monotone by each context's offset, and quantised values.

    ``starts`` points from each context to its first child. A child is found by successor search for its
    id relative to the context: the id plus the value before the context's first child.
    """

    def __init__(self, starts: EliasFano, ids: EliasFano, values: np.ndarray):
        self.starts, self.ids, self.values = starts, ids, values

    @classmethod
    def build(cls, contexts: int, parent: np.ndarray, child: np.ndarray, p: np.ndarray) -> Level:
        """``parent`` non-decreasing, ``child`` (below 2^31) increasing within a parent."""
        starts = np.searchsorted(parent, np.arange(contexts + 1))
        last = np.concatenate(([0], np.cumsum(np.where(np.diff(starts) > 0, child[np.maximum(starts[1:] - 1, 0)] + 1, 0)))) if len(child) else np.zeros(contexts + 1, np.int64)
        return cls(EliasFano.build(starts.astype(np.int64)), EliasFano.build((child + last[parent]).astype(np.int64)), quantise(p))

    def find(self, context: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of children and whether they are there; a negative context has none."""
        if not self.ids.n or not len(context):
            return np.zeros(len(context), np.int64), np.zeros(len(context), bool)
        known = context >= 0
        context = np.maximum(context, 0)
        low, high = self.starts.get(context), self.starts.get(context + 1)
        base = np.where(low > 0, self.ids.get(np.maximum(low - 1, 0)) + 1, 0)
        target = child + base
        at = np.minimum(self.ids.find(target), self.ids.n - 1)
        found = known & (at >= low) & (at < high)
        found[found] = self.ids.get(at[found]) == target[found]
        return at, found

    def dump(self) -> bytes:
        parts = self.starts.dump(), self.ids.dump()
        pad = [p + b"\0" * (-len(p) % 8) for p in parts]
        return struct.pack("<qqq", len(pad[0]), len(pad[1]), len(self.values)) + b"".join(pad) + self.values.tobytes() + b"\0" * (-len(self.values) % 8)

    @classmethod
    def load(cls, buffer: memoryview, at: int = 0) -> tuple[Level, int]:
        a, b, n = struct.unpack_from("<qqq", buffer, at)
        starts, _ = EliasFano.load(buffer, at + 24)
        ids, _ = EliasFano.load(buffer, at + 24 + a)
        end = at + 24 + a + b
        return cls(starts, ids, np.frombuffer(buffer, np.uint8, n, end)), end + n + (-n % 8)
