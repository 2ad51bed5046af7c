"""Ranked search as a blocked product of two sparse matrices: item x term (multiplicity times weight) by term x document (impacts), in int64.

Documents become blocks of about BLOCK_BYTES of text: postings by term, with the terms' bytes, so equal terms are equal bytes.  Statistics
(documents, terms, document frequencies of the items' terms) are summed over all blocks by Spark.  Items are taken ITEM_TERMS terms at a time; every block of
documents is multiplied by each block of items: the rows of the document matrix that an item's row names are merged into one
dense row of scores (Gustavson), of which the k best stay.  A task keeps k per item over all its blocks, and the tasks' lists meet by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import durable, small_batches
from ._text import SOLID_TERM, coded, slices, utf8

BLOCK_BYTES = 8 << 20
ITEM_TERMS = 200_000  # of a block of items, repeats included

_I8, _I4 = pa.list_(pa.int64()), pa.list_(pa.int32())
_BLOCK = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", _I8), ("sizes", _I8), ("terms", pa.list_(pa.binary())), ("first", _I4), ("docs", _I4), ("tf", _I4)])
_BLOCK_SQL = "n_docs long, n_terms long, ids array<long>, sizes array<long>, terms array<binary>, first array<int>, docs array<int>, tf array<int>"


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """Documents (those with terms) and their postings by term."""
    codes, at, terms = coded(data, offsets, SOLID_TERM, lower=True)
    size = np.diff(at)
    doc = np.repeat(np.cumsum(size > 0) - 1, size)
    ids, size = ids[size > 0], size[size > 0]
    pair, tf = np.unique(codes * max(1, len(ids)) + doc, return_counts=True)
    term, doc = np.divmod(pair, max(1, len(ids)))
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    arrays = [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), terms.cast(pa.binary()), pa.array(first, pa.int32()), pa.array(doc, pa.int32()), pa.array(tf, pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([len(codes)], pa.int64()), *map(_list, arrays)], schema=_BLOCK)


def _blocks(batches):
    held: list[tuple] = []

    def flush():
        sizes = np.concatenate([np.diff(o) for _, _, o in held])
        return _block(np.concatenate([i for i, _, _ in held]), np.concatenate([d for _, d, _ in held]), np.concatenate([[0], np.cumsum(sizes)]))

    size = 0
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in slices(offsets):
            held.append((ids[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            size += int(offsets[j] - offsets[i])
            if size >= BLOCK_BYTES:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of documents; rows with a null id and texts without terms are in none."""
    small_batches(docs.sparkSession, 2000)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null")
    return own.mapInArrow(_blocks, _BLOCK_SQL)


def _item_terms(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for i in range(batch.num_rows):
            codes, _, terms = coded(data[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i], SOLID_TERM, lower=True)
            if len(codes):
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("item")[i], len(terms)), terms.cast(pa.binary()), pa.array(np.bincount(codes), pa.int64())], ["item", "term", "times"])


class _Postings:
    """The rows of a block's term x document matrix that the items of one block use."""

    def __init__(self, block: dict, vocabulary: pa.Array, n: int, total: int):
        flat = lambda name: block[name].values.to_numpy(zero_copy_only=False)
        self.ids, size, self.first, self.docs, tf = (flat(c) for c in ("ids", "sizes", "first", "docs", "tf"))
        floor = 25 + 75 * size * n // total
        self.impacts = 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * floor[self.docs])
        self.row = pc.index_in(vocabulary, value_set=block["terms"].values).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One item's dense row of the product: weighted rows of its terms, added up."""
        rows = self.row[terms]
        out = np.zeros(len(self.ids), np.int64)
        for r, w in zip(rows[rows >= 0].tolist(), weights[rows >= 0].tolist()):
            a, b = self.first[r], self.first[r + 1]
            out[self.docs[a:b]] += w * self.impacts[a:b]  # a posting list holds a document once
        return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0, equal ones by id."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        bar = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= bar]
    order = found[np.lexsort((ids[found], -scores[found]))[:k]]
    return ids[order], scores[order]


def _product(held, k: int):
    def run(batches):
        items, first, terms, weights, vocabulary, n, total = held.value
        vocabulary = pa.array(vocabulary, pa.binary())
        best = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in range(len(items))}
        for batch in batches:
            for r in range(batch.num_rows):
                block = _Postings({c: batch.column(c)[r] for c in _BLOCK.names[2:]}, vocabulary, n, total)
                for i in best:
                    a, b = first[i], first[i + 1]
                    ids, scores = _best(block.ids, block.scores(terms[a:b], weights[a:b]), k)
                    if len(ids):
                        best[i] = _best(np.concatenate([best[i][0], ids]), np.concatenate([best[i][1], scores]), k)
        owner = np.repeat(items, [len(x) for x, _ in best.values()])
        yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), *(pa.array(np.concatenate([x[c] for x in best.values()]) if best else [], pa.int64()) for c in (0, 1))], ["item_id", "doc_id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for every item, equal scores by smaller id; all integers.

    Terms are runs of ASCII letters and digits and of all other characters that aren't ASCII, with A-Z lower-cased.  A term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))); a document adds weight * (10**9 tf div (1000 tf + 8 m)), m = 25 + 75 n N div L, for every occurrence in the item.

    Edges: null and empty texts have no terms and count nowhere; rows with a null id are left out on both sides; a text of any length is read whole; repeated
    document rows are ranked each; of the texts of a repeated item id one (the smallest) is used; other columns are not looked at; empty tables give no rows.
    """
    spark = docs.sparkSession
    blocks = durable(index(docs, id_col, text_col))
    n, total = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    schema = "item_id long, doc_id long, score long"
    own = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text")).where("item is not null")
    terms = own.groupBy("item").agg(F.min("text").alias("text")).mapInArrow(_item_terms, "item long, term binary, times long")
    if not n:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    terms = durable(terms)
    wanted = terms.select("term").distinct()
    held = blocks.select(F.explode(F.arrays_zip("terms", F.slice("first", F.lit(1), F.size("terms")).alias("a"), F.slice("first", F.lit(2), F.size("terms")).alias("b"))).alias("t"))
    counts = held.select(F.col("t.terms").alias("term"), (F.col("t.b") - F.col("t.a")).cast("long").alias("df")).join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighted = durable(terms.join(counts, "term").select("item", "term", (F.col("times") * weight).alias("weight")).where("weight > 0"))
    parts = max(1, -(-int(weighted.count()) // ITEM_TERMS))
    out = None
    for part in range(parts):
        rows = weighted.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("item", "term").toArrow()
        if not rows.num_rows:
            continue
        item = rows.column("item").to_numpy()
        coded_terms = rows.column("term").combine_chunks().dictionary_encode()
        start = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        sent = (item[start], np.append(start, len(item)), coded_terms.indices.to_numpy(), rows.column("weight").to_numpy(), coded_terms.dictionary.to_pylist(), n, total)
        some = blocks.mapInArrow(_product(spark.sparkContext.broadcast(sent), k), schema)
        out = some if out is None else out.unionByName(some)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
