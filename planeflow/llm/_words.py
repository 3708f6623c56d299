"""Words of many texts at once, on byte arrays.

A word is a run of bytes other than space and \\t\\n\\v\\f\\r; as UTF-8 never uses those bytes inside
a character, this equals the pattern [^\\x20\\x09-\\x0D]+ on characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
LONG_WORD = 1 << 14
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; BASE is odd, so it has an inverse."""
    if len(_tables.get("up", ())) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(size, base, U)
            x[0] = 1
            _tables[name] = np.multiply.accumulate(x)
    return _tables["up"], _tables["down"]


def byte_table() -> np.ndarray:
    """A random 64-bit value for each byte of a word, 0 for separators."""
    if "byte" not in _tables:
        x = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
        x[[32, 9, 10, 11, 12, 13]] = 0
        _tables["byte"] = x
    return _tables["byte"]


def separators() -> np.ndarray:
    if "sep" not in _tables:
        x = np.zeros(256, bool)
        x[[32, 9, 10, 11, 12, 13]] = True
        _tables["sep"] = x
    return _tables["sep"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary array without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]].

    starts, ends: byte positions; first: n + 1 indices of the texts' first words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        sep = separators()[data]
        begins = ~sep
        stops = begins.copy()
        begins[1:] &= sep[:-1]
        stops[:-1] &= sep[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]  # a text's end also ends a word
        begins[inner] |= ~sep[inner]
        stops[inner - 1] |= ~sep[inner - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every batch."""
        out = np.empty(len(self), U)
        lengths = self.ends - self.starts
        up, down = powers(BLOCK + 1)
        table, a = byte_table(), 0
        while a < len(self):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + BLOCK, "right")))
            if lengths[a] <= BLOCK:
                at = self.starts[a]
                part = table[self.data[at : self.ends[b - 1]]]
                part *= up[: len(part)]
                out[a:b] = np.add.reduceat(part, self.starts[a:b] - at) * down[self.starts[a:b] - at]
            a = b
        for i in np.flatnonzero(lengths > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest(), "little")
        return mix(out + lengths.astype(U))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each followed by one space, and where each begins (with one more: the end)."""
        lengths = self.ends - self.starts
        at = np.zeros(len(self) + 1, np.int64)
        np.cumsum(lengths + 1, out=at[1:])
        mask = np.zeros(len(self.data) + 1, np.int8)
        mask[self.starts] += 1
        mask[self.ends] -= 1
        body = self.data[np.cumsum(mask[:-1], dtype=np.int8).astype(bool)]
        out = np.full(at[-1], 32, np.uint8)
        gap = np.ones(at[-1], bool)
        gap[at[1:] - 1] = False
        out[gap] = body
        return out, at


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    factor = 1
    for j in range(k):
        out += hashes[j : j + n] * U(factor)
        factor = factor * 0xA0761D6478BD642F % 2**64
    return mix(out)


def long_windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """As windows(), by prefix sums: the cost doesn't depend on k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def slide_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours, by doubling."""
    width = 1
    while width * 2 <= k:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if width < k:
        x = np.minimum(x[: len(x) - (k - width)], x[k - width :])
    return x
