"""Array helpers used inside tasks: UTF-8 batches, words, sequence hashes, packed blocks.

A batch of texts is one byte array plus offsets.  A word is a maximal run of bytes other than
0x20 and 0x09-0x0D; those bytes never occur inside a multi-byte character, so this equals the
pattern ``[^\\x20\\x09-\\x0D]+`` on characters.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (murmur3's constants)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


@lru_cache(maxsize=2)  # a table that is sent by its name: tasks make their own
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, U(_P)), np.full(size, U(_PINV))
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n."""
    up, down = _powers(1 << max(21, n.bit_length()))
    return up[:n], down[:n]


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash() gives the hash of any run of symbols."""
    out = np.empty(len(symbols) + 1, U)
    out[0] = 0
    np.cumsum(symbols * powers(len(symbols))[0], out=out[1:])
    return out


def range_hash(pre: np.ndarray, start, end) -> np.ndarray:
    """Position-independent hash of symbols[start:end]; empty runs give 0."""
    return mix64((pre[end] - pre[start]) * powers(len(pre))[1][start])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of texts of about `most` bytes together (a longer text is alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word offsets of every text."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """Hash of every word, the word offsets of every text, and the words' byte ranges."""
    if lower:
        data = _LOWER[data]
    starts, ends, at = words(data, offsets)
    if not len(starts):
        return np.zeros(0, U), at, starts, ends
    return range_hash(prefix(_BYTE[data]), starts, ends), at, starts, ends


def shingles(hashes: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; a shorter text is one shingle as a whole, an empty one has none."""
    out, pre = [], prefix(hashes)
    grams = range_hash(pre, np.arange(max(0, len(hashes) - n + 1)), np.arange(n, len(hashes) + 1)) if len(hashes) >= n else np.zeros(0, U)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(range_hash(pre, np.array([a]), np.array([b])) ^ U(b - a))
        else:
            out.append(np.zeros(0, U))
    return out


_KINDS = [np.dtype(x) for x in ("u1", "u2", "u4", "u8", "i4", "i8")]


def pack(*arrays: np.ndarray) -> bytes:
    """One compressed block of several one-dimensional arrays."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<BI", _KINDS.index(a.dtype), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    at, out = 1 + 5 * raw[0], []
    for i in range(raw[0]):
        kind, n = struct.unpack_from("<BI", raw, 1 + 5 * i)
        out.append(np.frombuffer(raw, _KINDS[kind], n, at))
        at += n * _KINDS[kind].itemsize
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [starts[i], starts[i] + counts[i])."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


class HashMap:
    """64-bit hashes to float32 values in open addressing; look up a whole array at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.zeros(size, U), np.zeros(size, np.float32)
        keys = np.where(keys == 0, U(1), keys)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == 0
            self.keys[slot[left[free]]] = keys[left[free]]  # of several for one slot the last one stays
            done = self.keys[slot[left]] == keys[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: float = np.nan) -> np.ndarray:
        keys = np.where(keys == 0, U(1), keys)
        out, slot, left = np.full(len(keys), default, np.float32), self._slot(keys), np.arange(len(keys))
        while len(left):
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held != 0)]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        return out


_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges without up to `most` ASCII punctuation marks at either end; at least one byte stays."""
    starts, ends = starts.copy(), ends.copy()
    for _ in range(most):
        ends -= (ends - starts > 1) & _EDGE[data[ends - 1]]
        starts += (ends - starts > 1) & _EDGE[data[starts]]
    return starts, ends


def term_hashes(data: np.ndarray, offsets: np.ndarray):
    """Hashes of lower-cased words without punctuation at the ends, and the word offsets of every text."""
    data = _LOWER[data]
    starts, ends, at = words(data, offsets)
    if not len(starts):
        return np.zeros(0, U), at
    starts, ends = trimmed(data, starts, ends)
    return range_hash(prefix(_BYTE[data]), starts, ends), at


SOLID_WORD = ~_SPACE
#: Bytes of search terms: letters, digits and all of other characters than ASCII.
SOLID_TERM = np.zeros(256, bool)
SOLID_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def coded(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Maximal runs of `solid` bytes as numbers: codes, their offsets in every text, and the runs by code.  Equal codes are equal bytes, not equal hashes."""
    mask = solid[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = mask
    inside[1:] &= inside[:-1]
    inside[offsets] = False  # a run ends with its text
    starts = np.flatnonzero(mask & ~inside[:-1])
    total = np.concatenate([[0], np.cumsum(mask)])
    edges = np.append(total[starts], total[-1]).astype(np.int64)
    values = data[mask]
    values = np.ascontiguousarray(_LOWER[values] if lower else values)
    runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(values)]).dictionary_encode()
    return runs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offsets), runs.dictionary
