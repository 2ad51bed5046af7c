"""Exact BM25 top k: an inverted index per shard, block maxima to leave blocks out, shards merged under global statistics.

A shard is what a task reads up to SHARD_BYTES; its index is one row of packed arrays (documents, terms, postings, and for
every block of BLOCK documents of a postings list the largest frequency and the shortest document, which bound the score
whatever the corpus statistics are).  Document frequencies and the mean length are summed over all shards.  A task keeps the k
best per query over all its shards, so each shard starts with the bar the others have set (see `shard_top`); documents
are scored exactly, and the tasks' lists are merged by rank.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import durable, small_batches
from ._text import U, pack, slices, unpack, utf8, word_hashes

K1, B = 1.2, 0.75
SHARD_BYTES, BLOCK = 8 << 20, 64


def _build(ids: np.ndarray, terms: np.ndarray, at: np.ndarray) -> bytes:
    length = np.diff(at).astype(np.int32)
    order = np.argsort(terms, kind="stable")  # documents stay in order within a term
    t, d = terms[order], np.repeat(np.arange(len(ids), dtype=np.uint32), length)[order]
    new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]))) if len(t) else np.zeros(0, np.int64)
    tf, t, d = np.diff(np.append(new, len(t))).astype(np.int32), t[new], d[new]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
    edge = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (d[1:] // BLOCK != d[:-1] // BLOCK))) if len(t) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(tf, edge) if len(edge) else np.zeros(0, np.int32)
    least = np.minimum.reduceat(length[d], edge) if len(edge) else np.zeros(0, np.int32)
    return pack(ids, length, t[first], np.append(first, len(t)).astype(np.int64), d, tf, np.append(np.searchsorted(edge, first), len(edge)).astype(np.int64), (d[edge] // BLOCK).astype(np.uint32), most, least)


def _index(batches):
    def flush(held):
        ids, terms, sizes = (np.concatenate(x) for x in zip(*held))
        at = np.concatenate([[0], np.cumsum(sizes)])
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([int(at[-1])], pa.int64()), pa.array([_build(ids, terms, at)], pa.binary())], ["n_docs", "n_words", "shard"])

    held, size = [], 0
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in slices(offsets):
            terms, at, _, _ = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
            held.append((ids[i:j], terms, np.diff(at)))
            size += int(offsets[j] - offsets[i])
            if size >= SHARD_BYTES:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n_docs, n_words, shard): one row per shard; every row with an id is in one."""
    small_batches(docs.sparkSession, 2000)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return own.mapInArrow(_index, "n_docs long, n_words long, shard binary")


def _frequencies(held):
    def run(batches):
        wanted = held.value
        for batch in batches:
            for block in batch.column("shard").to_pylist():
                _, _, terms, first, *_ = unpack(block)
                at = np.minimum(np.searchsorted(terms, wanted), max(0, len(terms) - 1))
                has = np.flatnonzero(terms[at] == wanted) if len(terms) else np.zeros(0, np.int64)
                df = (first[1:] - first[:-1])[at[has]]
                yield pa.RecordBatch.from_arrays([pa.array(wanted[has].view(np.int64)), pa.array(df, pa.int64())], ["t", "df"])

    return run


def shard_top(arrays: list, terms: np.ndarray, idf: np.ndarray, mean: float, k: int, best: list[tuple[float, int]]) -> int:
    """Put a shard's documents for a query of distinct terms into `best`, a heap of the k best (score, -id) so far; the number of blocks scored.

    Block-max WAND over blocks of documents: every term's list of blocks has a cursor.  With the terms in the order of their cursors, the pivot
    is the first block at which the most that the terms so far can add reaches the k-th score; terms before it skip to it, as no block in between can
    hold one of the k best.  Once all have come to the pivot, its block maxima decide whether its documents are scored, and the cursors there
    move on.  The pivot moves faster as the k-th score rises.
    """
    ids, length, known, first, doc, tf, block_first, block, most, least = arrays
    if not len(known) or not len(terms):
        return 0
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    has = known[at] == terms
    at, idf = at[has], idf[has]
    blocks, bounds, lists = [], [], []
    for a, w in zip(at, idf):
        m, n = most[block_first[a] : block_first[a + 1]], least[block_first[a] : block_first[a + 1]]
        blocks.append(block[block_first[a] : block_first[a + 1]].tolist())
        bounds.append((w * m * (K1 + 1) / (m + K1 * (1 - B + B * n / mean))).tolist())
        lists.append((doc[first[a] : first[a + 1]], tf[first[a] : first[a + 1]], w))
    reach = lambda bound: (bound * (1 + 1e-9) >= best[0][0]) if len(best) == k else (bound > 0)
    top, cursor, now, scored = [max(x) for x in bounds], [0] * len(at), [x[0] for x in blocks], 0
    end = len(ids) // BLOCK + 1  # where the cursors of lists that have ended stand
    while True:
        pivot, upper = end, 0.0
        for t in sorted(range(len(at)), key=now.__getitem__):
            upper += top[t]
            if reach(upper):
                pivot = now[t]
                break
        if pivot == end:
            return scored
        goal = pivot
        if min(now) == pivot:
            goal, here = pivot + 1, [t for t, x in enumerate(now) if x == pivot]
            if reach(sum(bounds[t][cursor[t]] for t in here)):
                _score_block(pivot * BLOCK, [lists[t] for t in here], ids, length, mean, k, best)
                scored += 1
        for t, x in enumerate(now):
            if x < goal:
                cursor[t] = bisect_left(blocks[t], goal, cursor[t])
                now[t] = blocks[t][cursor[t]] if cursor[t] < len(blocks[t]) else end


def _score_block(lo: int, lists: list[tuple], ids: np.ndarray, length: np.ndarray, mean: float, k: int, best: list[tuple[float, int]]) -> None:
    """The documents from number `lo` on that hold one of the lists' terms, with their exact scores."""
    scores, found = np.zeros(BLOCK), np.zeros(BLOCK, bool)
    for d, f, w in lists:
        x, y = np.searchsorted(d, np.array([lo, lo + BLOCK], d.dtype))
        own, freq = d[x:y].astype(np.int64), f[x:y]
        scores[own - lo] += w * freq * (K1 + 1) / (freq + K1 * (1 - B + B * length[own] / mean))
        found[own - lo] = True
    for j in np.flatnonzero(found):
        entry = (float(scores[j]), -int(ids[lo + j]))
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)


def _top(held, k: int):
    def run(batches):
        queries, mean = held.value
        best: dict[int, list] = {q: [] for q, _, _ in queries}
        for batch in batches:
            for block in batch.column("shard").to_pylist():
                arrays = unpack(block)
                for q, terms, idf in queries:
                    shard_top(arrays, terms, idf, mean, k, best[q])
        rows = [(q, -i, s) for q, found in best.items() for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "doc_id", "score"])

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, query_block: int = 2000, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents with the highest BM25 score above 0 for every query; equal scores by smaller id.

    Words are lower-cased (A-Z) runs of characters other than space and 0x09-0x0D; a query counts each word once.
    Queries are sent `query_block` at a time over the stored index.

    Edges: null and empty texts count as documents of length 0; rows with null ids are left out on both sides; queries without a known word have no
    rows; a very long text is one document; repeated document rows are ranked each; of repeated query ids one text (the smallest) is used; empty tables give no rows.
    """
    spark = docs.sparkSession
    shards = durable(index(docs, id_col, text_col))
    n, total = shards.agg(F.sum("n_docs"), F.sum("n_words")).first()
    own = queries.select(F.col(query_id).cast("long").alias("q"), F.coalesce(F.col(query_text).cast("string"), F.lit("")).alias("t")).where("q is not null").groupBy("q").agg(F.min("t").alias("t"))
    schema = "query_id long, doc_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    mean = max(total / n, 1e-9)
    parts = max(1, -(-own.count() // query_block))
    out = None
    for part in range(parts):
        rows = own.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).orderBy("q").collect()
        terms, at, _, _ = word_hashes(*utf8(pa.array([r["t"] for r in rows], pa.large_string())), lower=True)
        wanted = np.unique(terms)
        found = shards.mapInArrow(_frequencies(spark.sparkContext.broadcast(wanted)), "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()
        known, df = found.column("t").to_numpy().view(U), found.column("df").to_numpy()
        weight = dict(zip(known.tolist(), np.log1p((n - df + 0.5) / (df + 0.5)).tolist()))
        sent = []
        for r, a, b in zip(rows, at[:-1], at[1:]):
            own_terms = np.array([t for t in np.unique(terms[a:b]).tolist() if t in weight], U)
            sent.append((r["q"], own_terms, np.array([weight[t] for t in own_terms.tolist()])))
        some = shards.mapInArrow(_top(spark.sparkContext.broadcast((sent, mean)), k), schema)
        out = some if out is None else out.unionByName(some)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
