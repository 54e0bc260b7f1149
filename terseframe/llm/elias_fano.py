"""Elias-Fano coded monotone sequences on memory-mapped bytes, with vectorised search."""

import numpy as np

_U = np.uint64
WORD = 64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value, one after the other, with 8 spare bytes at the end."""
    out = [np.empty(0, np.uint8)]
    for at in range(0, len(values), 1 << 15):  # whole bytes at every cut
        part = values[at : at + (1 << 15)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


class EliasFano:
    """A sorted sequence of n values below `universe`.

    The low bits of the values stand in a packed array. The high parts are unary: bit
    high(i) + i is set for value i, and each unset bit ends a high part. `zeros` counts the
    unset bits before every 64-bit word, which makes the start of a high part a search.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.high, self.zeros = n, width, high, zeros
        self.low = low
        self._at = np.ndarray((max(1, len(low) - 7),), "<u8", low, strides=(1,))

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> "EliasFano":
        n = len(values)
        width = min(56, max(0, int(universe // max(n, 1)).bit_length() - 1))  # a read of 8 bytes holds it
        upper = (values >> _U(width)).astype(np.int64)
        size = n + ((universe - 1) >> width) + 2
        bits = np.zeros(-(-size // WORD) * WORD, np.uint8)
        bits[upper + np.arange(n)] = 1
        bits[size:] = 1  # no end marks beyond the last
        high = np.packbits(bits, bitorder="little").view("<u8")
        free = WORD - np.bitwise_count(high).astype(np.int64)
        zeros = np.concatenate(([0], np.cumsum(free)))
        return cls(n, width, _pack(values, width), high, zeros)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.zeros]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> "EliasFano":
        head, low, high, zeros = parts
        return cls(int(head[0]), int(head[1]), low, high, zeros)

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.width
        return (self._at[bit >> 3] >> (bit & 7).astype(_U)) & _U((1 << self.width) - 1)

    def _zero(self, r: np.ndarray) -> np.ndarray:
        """Position of the r-th unset bit, from 0."""
        word = np.searchsorted(self.zeros, r, side="right") - 1
        rest = r - self.zeros[word]
        bits = ~self.high[word]
        at = np.zeros(len(r), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(bits & _U((1 << half) - 1)).astype(np.int64)
            go = rest >= here
            rest -= np.where(go, here, 0)
            at += np.where(go, half, 0)
            bits = np.where(go, bits >> _U(half), bits)
        return word * WORD + at

    def starts(self, high: np.ndarray) -> np.ndarray:
        """Index of the first value whose high part is at least `high`."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        h = high[some]
        out[some] = self._zero(h - 1) - (h - 1)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        words = np.arange(len(self.zeros)) * WORD - self.zeros
        word = np.searchsorted(words, i, side="right") - 1
        rest = i - words[word]
        bits = self.high[word]
        at = np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(bits & _U((1 << half) - 1)).astype(np.int64)
            go = rest >= here
            rest -= np.where(go, here, 0)
            at += np.where(go, half, 0)
            bits = np.where(go, bits >> _U(half), bits)
        upper = word * WORD + at - i
        return (upper.astype(_U) << _U(self.width)) | self._low(i)

    def _bounds(self, x: np.ndarray, lo: np.ndarray | int, hi: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        high = (x >> _U(self.width)).astype(np.int64)
        return np.maximum(self.starts(high), lo), np.minimum(self.starts(high + 1), hi)

    def _search(self, x: np.ndarray, lo: np.ndarray | int, hi: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place at or above x, end, low bits of x) among the places lo..hi-1 that share x's high part."""
        low = x & _U((1 << self.width) - 1)
        at, stop = self._bounds(x, lo, hi)
        end = stop.copy()
        todo = np.flatnonzero(at < end)
        while len(todo):  # halving, since a dense stretch may share a high part
            mid = (at[todo] + end[todo]) >> 1
            less = self._low(mid) < low[todo]
            at[todo[less]] = mid[less] + 1
            end[todo[~less]] = mid[~less]
            todo = todo[at[todo] < end[todo]]
        return at, stop, low

    def successor(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int = 1 << 62) -> np.ndarray:
        """Index of the first value at or above x among those lo..hi-1 that share its high part, else their end."""
        return self._search(x, lo, hi)[0] if self.n else np.zeros(len(x), np.int64)

    def find(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int = 1 << 62) -> np.ndarray:
        """Index of x among the values lo..hi-1, or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        at, stop, low = self._search(x, lo, hi)
        hit = np.flatnonzero(at < stop)
        hit = hit[self._low(at[hit]) == low[hit]]
        out = np.full(len(x), -1, np.int64)
        out[hit] = at[hit]
        return out


def store(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one byte string: a table of types and lengths, then the data at 8-byte steps."""
    head = [f"{a.dtype.str}:{len(a)}" for a in arrays]
    text = ";".join(head).encode()
    out = [len(text).to_bytes(8, "little"), text.ljust(-(-len(text) // 8) * 8)]
    for a in arrays:
        raw = a.tobytes()
        out.append(raw.ljust(-(-len(raw) // 8) * 8, b"\0"))
    return b"".join(out)


def load(buffer: np.ndarray) -> list[np.ndarray]:
    """The arrays of a stored byte string, as views of `buffer` (uint8, may be a memory map)."""
    n = int(buffer[:8].view("<i8")[0])
    at = 8 + -(-n // 8) * 8
    arrays = []
    for item in bytes(buffer[8 : 8 + n]).decode().split(";"):
        kind, size = item.rsplit(":", 1)
        raw = int(size) * np.dtype(kind).itemsize
        arrays.append(buffer[at : at + raw].view(kind))
        at += -(-raw // 8) * 8
    return arrays
