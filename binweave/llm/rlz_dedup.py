"""Removing repeated word windows by relative Lempel-Ziv parsing against indexed reference blocks.

The reference is the corpus itself, cut into blocks by k-word hashes: a block holds the text around its anchors (see
_windows) and indexes, for every window of `length` words there, where the smallest id has it.  A document visits
exactly the blocks its anchors point to; other blocks hold none of its windows.  There its stretches are parsed greedily
against the block's text: a factor starts at a window that a smaller id has and is made as long as its source goes on
like the document, word by word.  Factors of at least `length` words are duplicate spans.  Windows across a factor's end are
looked up as well, and factors that meet become one span.  Stretches that are equal as a whole are settled before, by
their hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix64, powers
from ._windows import Windows, compared, context_arrays, remove_repeats


def index_block(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct window hashes of a reference block and where in it the window of the smallest key is."""
    by = np.lexsort((keys, hashes))
    h = hashes[by]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], by[first]


def parse(spec: Windows, matrix: np.ndarray, real: np.ndarray, key: np.ndarray, off: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of every stretch: its row, the window it starts with and how many windows it covers.

    All rows are parsed together, one factor a turn.  The window at a row's position is looked up in the index, its words are compared
    with the source's, and the factor runs on word by word as far as the source does.  The next position is the first window that the
    factor doesn't hold, so windows across a factor's end are looked up too.
    """
    length = spec.length
    pre = np.zeros((len(matrix), spec.width + 1), np.uint64)
    np.cumsum(matrix * powers(spec.width)[0], 1, out=pre[:, 1:])
    ref_row = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    ref_at = spec.left - off[ref_row] + np.arange(len(ref_row)) - np.repeat(begin, count)  # column of a window's first word
    hashes = mix64((pre[ref_row, ref_at + length] - pre[ref_row, ref_at]) * powers(spec.width + 1)[1][ref_at])
    known, source = index_block(hashes, key[ref_row])
    rows, at = np.arange(len(count)), np.zeros(len(count), np.int64)
    found: list[tuple] = []
    while len(rows):
        here = begin[rows] + at
        src = source[np.searchsorted(known, hashes[here])]
        a, b, mine = ref_at[here], ref_at[src], ref_row[src]
        hit = key[rows] > key[mine]
        for w in range(length):
            hit &= matrix[rows, a + w] == matrix[mine, b + w]
        size, on = hit.astype(np.int64), hit.copy()  # windows in the factor
        for w in range(length, spec.width):
            on &= (at + w - length + 1 < count[rows]) & (a + w < spec.width) & (b + w < spec.width)
            i, j = np.minimum(a + w, spec.width - 1), np.minimum(b + w, spec.width - 1)
            on &= real[rows, i] & real[mine, j] & (matrix[rows, i] == matrix[mine, j])
            size += on
        found.append((rows[hit], at[hit], size[hit]))
        at = at + np.maximum(size, 1)
        more = at < count[rows]
        rows, at = rows[more], at[more]
    row, first, windows = (np.concatenate(x) for x in zip(*found))
    return row, first, windows


def _factor_block(spec: Windows, groups: int):
    def compare(part: pa.Table):
        key, off, count = (part.column(c).to_numpy().astype(np.int64) for c in ("key", "off", "count"))
        return parse(spec, *context_arrays(spec, part), key, off, count)

    return compared(spec, groups, compare)


def drop_repeated_words(docs: DataFrame, length: int = 13, k: int = 5, hot: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, kept): each text's words without those covered by a window of `length` words that also starts in a document with a smaller id.

    Words are maximal runs of characters other than space and 0x09-0x0D, unchanged.  spans are the maximal removed runs
    [start, end) of words; kept has the other words joined by one space.

    Edges: null text has no words; texts of fewer words stay whole; rows with equal ids don't count as smaller than one another,
    and a null id counts as larger than any other; repeats inside one document stay; texts of any length are read whole; every input row gives one row.
    """
    spec = Windows(length, k, True, hot)

    def compare(contexts: DataFrame, groups: int) -> DataFrame:
        return contexts.repartition(groups, F.col("lead")).mapInArrow(_factor_block(spec, groups), "kind int, grp int, block binary")

    def apply(ids: list, texts: list[bytes], spans: list[np.ndarray]) -> pa.Table:
        sizes, kept = [], []
        for text, cut in zip(texts, spans):
            own = text.split()
            sizes.append(len(own))
            kept.append(b" ".join(w for a, b in zip([0, *cut[:, 1]], [*cut[:, 0], len(own)]) for w in own[a:b]).decode())
        pairs = pa.array([[{"start": int(a), "end": int(b)} for a, b in cut] for cut in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pairs, pa.array(kept, pa.string())], ["doc_id", "n_words", "spans", "kept"])

    return remove_repeats(docs, spec, compare, apply, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string", id_col, text_col)
