"""Vectorised word scanning of Arrow string batches (numpy, no per-word Python).

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; a batch is read as
one byte array with document offsets, so the cost per word is a few array
operations. Hashes are polynomial prefix hashes modulo 2**64: the hash of any
run of words comes from two prefix values, so a 35-word window costs as much
as a 2-word one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes of text hashed at once (a longer word is hashed by itself).
CHUNK_BYTES = 1 << 18


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base
        self.inverse = pow(base, -1, 1 << 64)
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_byte_powers = _Powers(BYTE_BASE)
_window_powers = {base: _Powers(base) for base in WINDOW_BASES}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole result."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII letters lowered."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte array and ``n + 1`` offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``size`` bytes, in order; a longer one by itself."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(max(int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """The words of some documents: byte spans, and the first word of each
    document. ``edges`` marks bytes before which a word is cut as well."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, edges: np.ndarray | None = None):
        base = int(offsets[0])
        self.data = data[base:int(offsets[-1])]
        self.doc_start = offsets - base
        inside = (self.data != 32) & ((self.data < 9) | (self.data > 13))
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.doc_start] = True
        if edges is not None:
            edge[:-1] |= edges
        before = np.empty(len(self.data) + 1, bool)
        before[0] = False
        before[1:] = inside
        after = np.empty(len(self.data) + 1, bool)
        after[:-1] = inside
        after[-1] = False
        self.starts = np.flatnonzero(after & (~before | edge))
        self.ends = np.flatnonzero(before & (~after | edge))
        self.first = np.searchsorted(self.starts, self.doc_start)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word; equal words have equal hashes."""
        out = np.empty(len(self), U64)
        lo = 0
        while lo < len(self):
            base = int(self.starts[lo])
            hi = max(lo + 1, int(np.searchsorted(self.ends, base + CHUNK_BYTES, "right")))
            part = self.data[base:int(self.ends[hi - 1])]
            up, down = _byte_powers.get(len(part) + 1)
            prefix = np.zeros(len(part) + 1, U64)
            np.cumsum((part.astype(U64) + U64(1)) * up[:-1], out=prefix[1:])
            starts, ends = self.starts[lo:hi] - base, self.ends[lo:hi] - base
            raw = (prefix[ends] - prefix[starts]) * down[starts]
            out[lo:hi] = mix(raw + (ends - starts).astype(U64) * U64(0xFF51AFD7ED558CCD))
            lo = hi
        return out


def window_hashes(hashes: np.ndarray, width: int, at: np.ndarray, base: int) -> np.ndarray:
    """Hash of the ``width`` words from each word position ``at``."""
    up, down = _window_powers[base].get(len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[:-1], out=prefix[1:])
    return mix((prefix[at + width] - prefix[at]) * down[at])
