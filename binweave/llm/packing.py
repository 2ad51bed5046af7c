"""Token ids in fixed rows: best-fit-decreasing packing with a segment tree over bins' free room.

Tokens come from a public byte-pair vocabulary; its file is read on the driver and sent along.  A task packs its documents some
`window` tokens at a time, so nothing is shuffled and memory is bounded.  Documents longer than a row are split: full rows of
their own first, the rest is packed.  A packed row has the ids of several segments, their cumulative lengths and positions
that start again at each segment; what is left is padded.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches

#: Splits text into words before the merges; belongs to the vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RoomTree:
    """Bins by free room: counts of bins per room value, with the smallest room that is large enough found from a tree of sums."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, bin_: int, room: int) -> None:
        self.bins[room].append(bin_)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A bin with the least room of at least `need`, and that room."""
        i, count = need + self.size, self.count
        if not count[i]:
            while i > 1 and not (i % 2 == 0 and count[i + 1]):  # up to the first subtree on the right that has bins
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        if room >= len(self.bins):
            return None
        self._add(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; lengths are 1 to capacity.  Equal lengths keep their order."""
    tree, bins = RoomTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[item])
        if found is None:
            found = len(bins), capacity
            bins.append([])
        bins[found[0]].append(item)
        if found[1] > lengths[item]:
            tree.put(found[0], found[1] - lengths[item])
    return bins


def load_vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_SCHEMA = "ids array<int>, cu_seqlens array<int>, positions array<int>, doc_ids array<long>, parts array<int>, n_tokens int"


def _pack(held, capacity: int, window: int, pad: int):
    schema = pa.schema([("ids", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())), ("n_tokens", pa.int32())])

    def flush(segments):
        # (doc, part, ids): full rows are bins already
        whole = [[s] for s in segments if len(s[2]) == capacity]
        rest = [s for s in segments if len(s[2]) < capacity]
        bins = whole + [[rest[i] for i in b] for b in best_fit_decreasing([len(s[2]) for s in rest], capacity)]
        for a in range(0, len(bins), 256):
            some = bins[a : a + 256]
            ids = np.full((len(some), capacity), pad, np.int32)
            positions = np.zeros((len(some), capacity), np.int32)
            ends = []
            for row, segs in enumerate(some):
                at, cuts = 0, [0]
                for _, _, part in segs:
                    ids[row, at : at + len(part)] = part
                    positions[row, at : at + len(part)] = np.arange(len(part))
                    at += len(part)
                    cuts.append(at)
                ends.append(cuts)
            rows = pa.array(np.arange(len(some) + 1, dtype=np.int32) * capacity)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(rows, pa.array(ids.ravel())), pa.array(ends, pa.list_(pa.int32())), pa.ListArray.from_arrays(rows, pa.array(positions.ravel())),
                 pa.array([[s[0] for s in segs] for segs in some], pa.list_(pa.int64())), pa.array([[s[1] for s in segs] for segs in some], pa.list_(pa.int32())), pa.array([e[-1] for e in ends], pa.int32())],
                schema=schema,
            )

    def run(batches):
        import tiktoken

        ranks = held.value
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        segments, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                ids = np.array(coder.encode_ordinary(text), np.int32)
                for part, a in enumerate(range(0, len(ids), capacity)):
                    segments.append((doc, part, ids[a : a + capacity]))
                size += len(ids)
                if size >= window:
                    yield from flush(segments)
                    segments, size = [], 0
        if segments:
            yield from flush(segments)

    return run


def pack(docs: DataFrame, vocabulary: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", capacity: int = 2048, window: int = 1 << 20, pad: int = 50_256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `capacity` ids: ids, cu_seqlens (0 first), positions, doc_ids and parts of the segments, n_tokens before padding.

    Part p of a document holds its tokens from p * capacity on, so documents can be put together again.  Rows depend on how the table is
    split into tasks, the segments do not.

    Edges: null and empty texts have no tokens and no segment; null ids stay null; rows that repeat an id are packed each; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_pack(held, capacity, window, pad), _SCHEMA)


def decode(row, vocabulary: dict[bytes, int]) -> list[tuple[int | None, int, bytes]]:
    """(doc id, part, bytes) of the segments of a packed row."""
    words = {i: b for b, i in vocabulary.items()}
    return [(d, p, b"".join(words[i] for i in row["ids"][a:b])) for d, p, a, b in zip(row["doc_ids"], row["parts"], row["cu_seqlens"], row["cu_seqlens"][1:])]


def _as_bytes(batches):
    for batch in batches:
        columns = []
        for name, column in zip(batch.schema.names, batch.columns):
            if name in ("ids", "positions"):
                column = pa.array([np.asarray(x.values, "<i4").tobytes() for x in column], pa.binary())
            columns.append(column)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def save_binary(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet with ids and positions as little-endian 32-bit rows, which stack to a matrix without decoding."""
    out = packed.mapInArrow(_as_bytes, "ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, parts array<int>, n_tokens int")
    out.write.mode("overwrite").parquet(path)
