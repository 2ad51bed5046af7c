"""Removing repeated byte strings with a sparse suffix array built by range partitioning.

Suffixes are taken at anchors (see _windows), range-partitioned by their leading bytes with splitters that
Spark samples, and sorted in each bucket by multikey quicksort.  A splitter is a whole k-byte prefix, so
suffixes that agree in it never lie on both sides of a bucket's boundary; and as every window of `length`
bytes has its anchor's k bytes, no repeat crosses one.  In suffix order the common prefix with either
neighbour bounds how far right a window can be shared; windows within that reach are brought together by their hashes and
compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import _BYTE, mix64, powers
from ._windows import Windows, compared, context_arrays, remove_repeats


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of unsigned words, most significant column first: three-way partitions around a pivot, one column at a time."""
    n, width = keys.shape
    out, at = np.empty(n, np.int64), 0
    stack = [(np.arange(n), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= 64 or depth >= width:
            if depth < width and len(rows) > 1:
                rows = rows[np.lexsort(tuple(keys[rows, c] for c in range(width - 1, depth - 1, -1)))]
            out[at : at + len(rows)] = rows
            at += len(rows)
            continue
        column = keys[rows, depth]
        pivot = np.partition(column[:: max(1, len(rows) // 63)], len(column[:: max(1, len(rows) // 63)]) // 2)[len(column[:: max(1, len(rows) // 63)]) // 2]
        less, same = column < pivot, column == pivot
        stack += [(part, d) for part, d in ((rows[~less & ~same], depth), (rows[same], depth + 1), (rows[less], depth)) if len(part)]
    return out


def _as_words(matrix: np.ndarray) -> np.ndarray:
    n, width = matrix.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = matrix
    return wide.view(">u8").astype(np.uint64)


def shared_windows(spec: Windows, matrix: np.ndarray, real: np.ndarray, key: np.ndarray, off: np.ndarray, count: np.ndarray):
    """Row and first offset of every window (owned by the row's anchor) that a row with a smaller key has too."""
    suffix, in_text = matrix[:, spec.left :], real[:, spec.left :]
    order = multikey_quicksort(np.hstack([_as_words(suffix), in_text.sum(1).astype(np.uint64)[:, None]]))
    same = (suffix[order[1:]] == suffix[order[:-1]]) & in_text[order[1:]] & in_text[order[:-1]]
    common = np.where(same.all(1), spec.length, np.argmin(same, 1)) if len(order) > 1 else np.zeros(0, np.int64)
    reach = np.zeros(len(order), np.int64)
    reach[order[1:]] = common
    reach[order[:-1]] = np.maximum(reach[order[:-1]], common)
    symbols = _BYTE[matrix] if matrix.dtype == np.uint8 else matrix
    pre = np.zeros((len(matrix), spec.width + 1), np.uint64)
    np.cumsum(symbols * powers(spec.width)[0], 1, out=pre[:, 1:])
    down = powers(spec.width + 1)[1]
    rows, offs, hashes = [], [], []
    for behind in range(spec.left + 1):  # symbols of the window before the anchor
        r = np.flatnonzero((behind <= off) & (behind > off - count) & (spec.length - behind <= reach))
        if len(r):
            a = spec.left - behind
            rows.append(r)
            offs.append(off[r] - behind)
            hashes.append(mix64((pre[r, a + spec.length] - pre[r, a]) * down[a]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, offs, hashes = np.concatenate(rows), np.concatenate(offs), np.concatenate(hashes)
    by = np.lexsort((key[rows], hashes))
    of = np.cumsum(np.append(True, hashes[by][1:] != hashes[by][:-1])) - 1
    of = _told_apart(np.lib.stride_tricks.sliding_window_view(matrix, spec.length, axis=1), rows[by], spec.left - off[rows[by]] + offs[by], of)
    by = by[np.lexsort((key[rows[by]], of))]
    of, k = np.sort(of), key[rows[by]]
    first = np.append(True, of[1:] != of[:-1])
    later = by[k > k[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]]
    return rows[later], offs[later]


def _told_apart(windows: np.ndarray, row: np.ndarray, at: np.ndarray, of: np.ndarray, step: int = 100_000) -> np.ndarray:
    """Group numbers that equal bytes share and others don't, from groups (neighbours here) of equal hashes."""
    lead = np.maximum.accumulate(np.where(np.append(True, of[1:] != of[:-1]), np.arange(len(of)), 0))
    same = np.concatenate([(windows[row[i : i + step], at[i : i + step]] == windows[row[lead[i : i + step]], at[lead[i : i + step]]]).all(1) for i in range(0, len(of), step)])
    if same.all():
        return of
    mixed = np.flatnonzero(np.isin(of, of[~same]))
    texts = np.ascontiguousarray(windows[row[mixed], at[mixed]])
    number = np.unique(texts.view(np.dtype((np.void, texts.shape[1] * texts.itemsize))).ravel(), return_inverse=True)[1]
    out = of.copy()
    out[mixed] = of.max() + 1 + number
    return out


def _compare_bucket(spec: Windows, groups: int):
    def compare(part: pa.Table):
        key, off, count = (part.column(c).to_numpy() for c in ("key", "off", "count"))
        rows, at = shared_windows(spec, *context_arrays(spec, part), key, off, count)
        return rows, at, np.ones(len(rows), np.int64)

    return compared(spec, groups, compare)


def drop_repeated_bytes(docs: DataFrame, length: int = 50, k: int = 20, hot: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each text without the bytes covered by a string of `length` bytes that also starts in a document with a smaller id.

    spans are the maximal removed runs [start, end) of UTF-8 bytes, kept is the rest (binary: a cut can fall inside a character).

    Edges: null text counts as empty; texts shorter than `length` stay whole; rows with equal ids don't count as smaller
    than one another, and a null id counts as larger than any other; repeats inside one document stay; texts of any length are read whole; every input row gives one row.
    """
    spec = Windows(length, k, False, hot)

    def compare(contexts: DataFrame, groups: int) -> DataFrame:
        dealt = contexts.repartitionByRange(groups, F.col("lead"))
        return dealt.mapInArrow(_compare_bucket(spec, groups), "kind int, grp int, block binary")

    def apply(ids: list, texts: list[bytes], spans: list[np.ndarray]) -> pa.Table:
        kept = [b"".join(raw[a:b] for a, b in zip([0, *cut[:, 1]], [*cut[:, 0], len(raw)])) for raw, cut in zip(texts, spans)]
        pairs = pa.array([[{"start": int(a), "end": int(b)} for a, b in cut] for cut in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pairs, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return remove_repeats(docs, spec, compare, apply, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary", id_col, text_col)
