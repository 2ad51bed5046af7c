"""Every window of `length` symbols of a document that also starts in a document with a smaller id.

Symbols are bytes or words.  A window's anchor is the place of its smallest k-symbol hash, so equal windows
have equal anchors at equal places, and one anchor answers for a run of neighbouring windows.

1. `anchors`: tasks reduce documents to anchors (about 2 / (length - k + 2) of the symbols): hash of the
   k-gram, hash of all that its windows can see (its context), document, place.  Within a task, of equal
   contexts only those of the smallest id go on; the others are repeats already.  So a context that is in a third
   of all documents reaches its bucket once per task.
2. `resolve`: one bucket per range of k-gram hashes.  Of equal contexts all but the smallest id's are
   repeats; k-grams with one context are unique; k-grams with several contexts are `open`, those with more than
   `hot` contexts are hot too.
3. `contexts`: the open anchors meet their text again and give their context as rows, known by their k-gram.  A hot
   k-gram is split: each window is a row of its own, known by all its symbols.  Of the rows of one window in a group of
   documents only those of the smallest id go on; the others are repeats already.  So at most `hot` rows of a k-gram, or
   those of one id per group of a window, meet in a task.
4. The caller compares the open contexts of a k-gram (suffix order for bytes, factors for words).
5. `gather`: a document's spans are merged and applied to its text.

Documents are known by (id, CRC32 of the text); a null id counts as larger than any other.  Blocks of packed
arrays keep the shuffles small; their number follows the bytes of the input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import shuffle_partitions, small_batches
from ._text import _BYTE, mix64, pack, prefix, range_hash, slices, spread, unpack, utf8, word_hashes

BLOCK_BYTES = 8 << 20
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Windows:
    """length: symbols in a window; k: symbols in an anchor's k-gram; by_word: else by byte; hot: contexts of a k-gram from which its windows are dealt one by one."""

    length: int
    k: int
    by_word: bool
    hot: int = 50_000

    @property
    def left(self) -> int:
        return self.length - self.k

    @property
    def width(self) -> int:
        return self.left + self.length


def symbols(spec: Windows, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every symbol and the symbol offsets of every text."""
    if spec.by_word:
        hashes, at, _, _ = word_hashes(data, offsets)
        return hashes, at
    return _BYTE[data], offsets


def find_anchors(spec: Windows, sym: np.ndarray, at: np.ndarray):
    """First window, number of windows and place of each anchor, its text, k-gram hash and context hash."""
    n, k, length = len(sym), spec.k, spec.length
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    pre = prefix(sym)
    grams = range_hash(pre, np.arange(n - k + 1), np.arange(k, n + 1))
    low = np.uint64((1 << max(24, n.bit_length())) - 1)
    best, reach = (grams & ~low) | np.arange(n - k + 1, dtype=np.uint64), 1
    size = spec.left + 1
    while 2 * reach <= size:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if size > reach:
        best = np.minimum(best[: n - length + 1], best[size - reach : size - reach + n - length + 1])
    place = (best & low).astype(np.int64)
    edge = np.zeros(n + 2, np.int32)
    whole = np.maximum(at[1:] - at[:-1] - length + 1, 0)
    np.add.at(edge, at[:-1], (whole > 0).astype(np.int32))
    np.add.at(edge, at[:-1] + whole, -(whole > 0).astype(np.int32))
    start = np.flatnonzero(np.cumsum(edge[: n - length + 1]) > 0)
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    place = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    start, place = start[first], place[first]
    text = np.searchsorted(at, start, "right") - 1
    lo, hi = np.maximum(place - spec.left, at[text]), np.minimum(place + length, at[text + 1])
    shape = ((place - lo) * (length + 1) + (hi - place)).astype(np.uint64)
    # anchors have small hashes; hashed once more they spread evenly over the buckets
    return start, count, place, text, mix64(grams[place] + np.uint64(1)), mix64(range_hash(pre, lo, hi) + shape)


def _anchor_blocks(spec: Windows, buckets: int):
    """Rows (slot, block): slots below `buckets` are ranges of k-gram hashes, from there on groups of documents."""

    def flush(held, docs):
        gram, context, start, off, count, doc = (np.concatenate(x) for x in zip(*held))
        key, crc = (np.array(x) for x in zip(*docs))
        key, crc = key.astype(np.int64), crc.astype(np.uint32)
        mine = key[doc]
        order = np.lexsort((mine, context, gram))
        first = np.ones(len(order), bool)
        g, c, m = gram[order], context[order], mine[order]
        first[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        least = m[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        known = np.zeros(len(order), bool)
        known[order] = m > least
        group = _group(key, crc, buckets)
        yield from _span_blocks(key, crc, group, doc[known], start[known], count[known] + spec.length - 1, buckets)
        at = np.flatnonzero(~known)
        slot = ((gram[at] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(slot, kind="stable")
        at, slot = at[by], slot[by]
        ends = np.flatnonzero(np.diff(slot, append=-1)) + 1
        for a, b in zip(np.append(0, ends[:-1]), ends) if len(slot) else ():
            i = at[a:b]
            used, d = np.unique(doc[i], return_inverse=True)
            yield int(slot[a]), pack(
                key[used], crc[used], np.diff(d, prepend=0).astype(np.uint32), np.diff(start[i], prepend=0).astype(np.int32), off[i].astype(np.uint8), count[i].astype(np.uint8),
                (gram[i] & np.uint64(0xFFFFFFFF)).astype(np.uint32), context[i].astype(np.uint32), (context[i] >> np.uint64(32)).astype(np.uint16),
            )

    def run(batches):
        held, docs, size = [], [], 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            key, crc = batch.column("key").to_numpy(zero_copy_only=False), batch.column("crc").to_numpy(zero_copy_only=False)
            for i, j in slices(offsets, 1 << 19):
                sym, at = symbols(spec, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                start, count, place, text, gram, context = find_anchors(spec, sym, at)
                held.append((gram, context, start - at[text], place - start, count, text + len(docs)))
                docs.extend(zip(key[i:j].tolist(), crc[i:j].tolist()))
                size += int(offsets[j] - offsets[i])
                if size >= BLOCK_BYTES:
                    yield from _rows(flush(held, docs))
                    held, docs, size = [], [], 0
        if held:
            yield from _rows(flush(held, docs))

    return run


def _document_blocks(groups: int):
    """Rows (grp, block) of packed documents: key, crc, whether the id is null, text length, texts."""

    def flush(held):
        key, crc, null, size = (np.concatenate([h[i] for h in held]) for i in range(4))
        data = np.concatenate([h[4] for h in held])
        at = np.cumsum(size) - size
        group = _group(key, crc, groups)
        order = np.argsort(group, kind="stable")
        cut = np.flatnonzero(np.diff(group[order], append=-1)) + 1
        for a, b in zip(np.append(0, cut[:-1]), cut):
            i = order[a:b]
            yield int(group[i[0]]), pack(key[i], crc[i].astype(np.uint32), null[i].astype(np.uint8), size[i], data[spread(at[i], size[i])])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = utf8(batch.column("text"))
            held.append((batch.column("key").to_numpy(zero_copy_only=False), batch.column("crc").to_numpy(zero_copy_only=False), np.asarray(batch.column("id").is_null()), np.diff(offsets), data))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield from _rows(flush(held), "grp")
                held, size = [], 0
        if held:
            yield from _rows(flush(held), "grp")

    return run


def _documents(table: pa.Table):
    """(key, crc), whether the id is null, text bytes of every document of a group."""
    for block in table.column("block").to_pylist():
        key, crc, null, size, data = unpack(block)
        raw, at = data.tobytes(), 0
        for k, c, z, n in zip(key.tolist(), crc.tolist(), null.tolist(), size.tolist()):
            yield (k, c), z, raw[at : at + n]
            at += n


def _rows(found, name: str = "slot"):
    slots, blocks = [], []
    for slot, block in found:
        slots.append(slot)
        blocks.append(block)
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(blocks, pa.binary())], [name, "block"])


def _group(key: np.ndarray, crc: np.ndarray, groups: int) -> np.ndarray:
    """Group of a document."""
    return (key % groups + crc.astype(np.int64) % groups) % groups


def _span_blocks(key, crc, group, doc, start, size, base):
    """Blocks of spans for the groups of documents."""
    if not len(doc):
        return
    by = np.lexsort((start, doc, group[doc]))
    doc, start, size = doc[by], start[by], size[by]
    g = group[doc]
    # abutting and overlapping spans of a document are one
    ends = start + size
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > ends[:-1])
    first = np.flatnonzero(new)
    doc, g, start, ends = doc[first], g[first], start[first], np.maximum.reduceat(ends, first)
    cut = np.flatnonzero(np.diff(g, append=-1)) + 1
    for a, b in zip(np.append(0, cut[:-1]), cut):
        used, d = np.unique(doc[a:b], return_inverse=True)
        yield base + int(g[a]), pack(key[used], crc[used], d.astype(np.uint32), start[a:b].astype(np.int32), (ends[a:b] - start[a:b]).astype(np.int32))


def _resolve(spec: Windows, buckets: int):
    """Rows (kind, grp, block): kind 0 has spans, kind 1 open anchors of the documents of a group."""
    schema = pa.schema([("kind", pa.int32()), ("grp", pa.int32()), ("block", pa.binary())])

    def run(slot, table):
        slot = slot[0].as_py()
        blocks = table.column("block").to_pylist()
        if slot >= buckets:
            return pa.table([pa.array([0] * len(blocks), pa.int32()), pa.array([slot - buckets] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], schema=schema)
        parts, keys, crcs, n = [], [], [], 0
        for block in blocks:
            key, crc, doc, start, off, count, gram, c_low, c_high = unpack(block)
            parts.append((np.cumsum(doc, dtype=np.uint32).astype(np.int64) + n, np.cumsum(start, dtype=np.int32), off, count, gram, c_low.astype(np.uint64) | c_high.astype(np.uint64) << np.uint64(32)))
            keys.append(key)
            crcs.append(crc)
            n += len(key)
        doc, start, off, count, gram, context = (np.concatenate(x) for x in zip(*parts))
        key, crc = np.concatenate(keys), np.concatenate(crcs)
        order = np.lexsort((key[doc], context, gram))
        doc, start, off, count, gram, context = (x[order] for x in (doc, start, off, count, gram, context))
        mine = key[doc]
        new_gram = np.ones(len(gram), bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        new = new_gram.copy()
        new[1:] |= context[1:] != context[:-1]
        least = mine[np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))]
        repeat = mine > least
        run_of = np.cumsum(new_gram) - 1
        contexts = np.bincount(run_of, new)[run_of]
        several, hot = contexts > 1, contexts > spec.hot
        is_open = ~repeat & several
        group = _group(key, crc, buckets)
        out = [(0, g - buckets, b) for g, b in _span_blocks(key, crc, group, doc[repeat], start[repeat].astype(np.int64), count[repeat].astype(np.int64) + spec.length - 1, buckets)]
        doc, start, off, count, hot = (x[is_open] for x in (doc, start, off, count, hot))
        by = np.argsort(group[doc], kind="stable")
        doc, start, off, count, hot = (x[by] for x in (doc, start, off, count, hot))
        cut = np.flatnonzero(np.diff(group[doc], append=-1)) + 1
        for a, b in zip(np.append(0, cut[:-1]), cut) if len(doc) else ():
            used, d = np.unique(doc[a:b], return_inverse=True)
            out.append((1, int(group[doc[a]]), pack(key[used], crc[used], d.astype(np.uint32), start[a:b], off[a:b], count[a:b], hot[a:b].astype(np.uint8))))
        kinds, groups, packed = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(kinds, pa.int32()), pa.array(groups, pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    return run


def _contexts(spec: Windows):
    """Rows of the open anchors.  lead: symbols that rows must share to be compared; context: the symbols seen, `before` of them left of the anchor, empty if the windows are known to be repeats."""
    schema = pa.schema([("lead", pa.binary()), ("context", pa.binary()), ("before", pa.int32()), ("key", pa.int64()), ("crc", pa.int64()), ("start", pa.int32()), ("off", pa.int32()), ("count", pa.int32())])

    def run(_, docs, found):
        cols: list[list] = [[] for _ in schema.names]
        held: dict = {}
        split: list[tuple] = []
        least: dict[bytes, int] = {}
        for block in found.column("block").to_pylist():
            key, crc, doc, *rest = unpack(block)
            order = np.argsort(doc, kind="stable")
            doc, rest = doc[order], [x[order] for x in rest]
            cuts = np.flatnonzero(np.diff(doc.astype(np.int64), append=-1)) + 1
            for a, b in zip(np.append(0, cuts[:-1]), cuts):
                held.setdefault((int(key[doc[a]]), int(crc[doc[a]])), []).append([x[a:b] for x in rest])
        for k, _, text in _documents(docs):
            if (parts := held.pop(k, None)) is None:  # a row like one before needs no second look
                continue
            start, off, count, hot = (np.concatenate(x) for x in zip(*parts))
            sym = np.frombuffer(text, np.uint8)
            if spec.by_word:
                sym, _, _, _ = word_hashes(sym, np.array([0, len(sym)]))
            place = start.astype(np.int64) + off
            lo, hi = np.maximum(place - spec.left, 0), np.minimum(place + spec.length, len(sym))
            wide = sym.dtype.itemsize
            raw = sym.tobytes()
            cool = np.flatnonzero(hot == 0)
            for i in cool:
                cols[0].append(raw[place[i] * wide : (place[i] + spec.k) * wide])
                cols[1].append(raw[lo[i] * wide : hi[i] * wide])
            for c, v in zip(cols[2:], (place - lo, np.full(len(lo), k[0]), np.full(len(lo), k[1]), start, off, count)):
                c.append(np.asarray(v)[cool])
            for i in np.flatnonzero(hot):
                for at in range(start[i], start[i] + count[i]):
                    window = raw[at * wide : (at + spec.length) * wide]
                    split.append((window, k[0], k[1], at, int(place[i]) - at))
                    least[window] = min(k[0], least.get(window, k[0]))
        for window, key, crc, at, before in split:
            first = key == least[window]
            cols[0].append(window if first else b"%d" % key)
            cols[1].append(window if first else b"")
            for c, v in zip(cols[2:], (before, key, crc, at, before, 1)):
                c.append(np.array([v]))
        arrays = [pa.array(c, f.type) if i < 2 else pa.array(np.concatenate(c) if c else [], f.type) for i, (c, f) in enumerate(zip(cols, schema))]
        return pa.table(arrays, schema=schema)

    return run


def context_arrays(spec: Windows, table: pa.Table) -> tuple[np.ndarray, ...]:
    """Contexts as a matrix of symbols with the anchor in column `left` (0 beyond a text's ends), and which columns are real."""
    dtype = np.uint64 if spec.by_word else np.uint8
    data, offsets = utf8(table.column("context"))
    n, wide = len(offsets) - 1, np.dtype(dtype).itemsize
    flat = np.frombuffer(data.tobytes(), dtype)
    offsets = offsets // wide
    lens, before = np.diff(offsets), table.column("before").to_numpy()
    matrix, real = np.zeros((n, spec.width), dtype), np.zeros((n, spec.width), bool)
    rows, cols = np.repeat(np.arange(n), lens), spread(spec.left - before.astype(np.int64), lens)
    matrix[rows, cols] = flat
    real[rows, cols] = True
    return matrix, real


def compared(spec: Windows, groups: int, compare: Callable, step: int = 50_000):
    """A function for mapInArrow: rows of _contexts, dealt by their lead, to blocks of spans.

    `compare` gets rows in the order of their leads, all of a lead at once, and returns row, first window in it and number of windows of the repeats.
    """
    schema = pa.schema([("kind", pa.int32()), ("grp", pa.int32()), ("block", pa.binary())])

    def spans(part, row, first, windows):
        key, crc, start = (part.column(c).to_numpy() for c in ("key", "crc", "start"))
        return span_rows(spec, key[row], crc[row], start[row] + first, windows + spec.length - 1, groups).cast(schema).to_batches()

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        known = pc.equal(pc.binary_length(table.column("context")), 0)
        part = table.filter(known)
        yield from spans(part, np.arange(len(part)), 0, part.column("count").to_numpy())
        table = table.filter(pc.invert(known)).sort_by("lead")
        if not len(table):
            return
        lead = table.column("lead").combine_chunks()
        edges = np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(lead[1:], lead[:-1]).to_numpy(zero_copy_only=False)), [len(lead)]])
        a = 0
        while a < len(edges) - 1:
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + step, "right")) - 1)
            part = table.slice(edges[a], edges[b] - edges[a])
            yield from spans(part, *compare(part))
            a = b

    return run


def span_rows(spec: Windows, key, crc, start, size, groups: int) -> pa.Table:
    """Spans as blocks for gather()."""
    ids, doc = np.unique(np.stack([key, crc.astype(np.int64)]), axis=1, return_inverse=True)
    doc = doc.ravel()
    found = list(_span_blocks(ids[0], ids[1].astype(np.uint32), _group(ids[0], ids[1], groups), doc, start.astype(np.int64), size.astype(np.int64), 0)) if len(key) else []
    return pa.table([pa.array([0] * len(found), pa.int32()), pa.array([g for g, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["kind", "grp", "block"])


def _gather(apply: Callable):
    def run(_, docs, found):
        held: dict = {}
        for block in found.column("block").to_pylist():
            key, crc, doc, start, size = unpack(block)
            order = np.argsort(doc, kind="stable")
            doc, start, size = doc[order], start[order], size[order]
            cuts = np.flatnonzero(np.diff(doc.astype(np.int64), append=-1)) + 1
            for a, b in zip(np.append(0, cuts[:-1]), cuts) if len(doc) else ():
                held.setdefault((int(key[doc[a]]), int(crc[doc[a]])), []).append((start[a:b], size[a:b]))
        ids, texts, spans = [], [], []
        for k, null, text in _documents(docs):
            ids.append(None if null else k[0])
            texts.append(text)
            parts = held.get(k)
            if not parts:
                spans.append(np.zeros((0, 2), np.int64))
                continue
            start, size = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate((start + size)[order])
            new = np.ones(len(start), bool)
            new[1:] = start[1:] > end[:-1]
            first = np.flatnonzero(new)
            spans.append(np.stack([start[first], np.append(end[first[1:] - 1], end[-1])], 1))
        return apply(ids, texts, spans)

    return run


def remove_repeats(docs: DataFrame, spec: Windows, compare: Callable[[DataFrame, int], DataFrame], apply: Callable, schema: str, id_col: str, text_col: str) -> DataFrame:
    """`compare` turns open contexts into span blocks; `apply` gets ids, texts (bytes) and spans of documents and returns a table of `schema`."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(shuffle_partitions(docs.sparkSession), total // BLOCK_BYTES + 1)
    own = own.withColumn("key", F.coalesce("id", F.lit(LAST))).withColumn("crc", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    small_batches(docs.sparkSession)
    anchors = own.select("key", "crc", "text").mapInArrow(_anchor_blocks(spec, groups), "slot int, block binary")
    resolved = anchors.groupBy("slot").applyInArrow(_resolve(spec, groups), "kind int, grp int, block binary")
    by_group = own.mapInArrow(_document_blocks(groups), "grp int, block binary").groupBy("grp")
    context_schema = "lead binary, context binary, before int, key long, crc long, start int, off int, count int"
    contexts = by_group.cogroup(resolved.where("kind = 1").groupBy("grp")).applyInArrow(_contexts(spec), context_schema)
    spans = resolved.where("kind = 0").unionByName(compare(contexts, groups))
    return by_group.cogroup(spans.groupBy("grp")).applyInArrow(_gather(apply), schema)
