"""Approximate nearest neighbours by cosine: a forest of hash prefixes in every shard, the shards' answers merged.

Each tree hashes a vector to a string of symbols; a symbol is the largest coordinate, with its sign, of the vector seen in `width` random
orthogonal directions (2 * width symbols).  A tree is the shard's rows sorted by string.  A query finds the rows with the longest
prefix in common in all trees, then ascends symbol by symbol in all trees at once, taking the trees in order, until enough entries
have been met; the rows met are compared exactly.  Equal vectors are one row with their smallest ids, so
copies neither crowd out others nor lose ties.  All rows are indexed; queries come in blocks of bounded size against every shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import durable, shuffle_partitions

SHARD_BYTES, QUERY_BYTES = 16 << 20, 8 << 20
_SHARD = pa.schema([("ids", pa.list_(pa.list_(pa.int64()))), ("vectors", pa.binary()), ("keys", pa.binary()), ("order", pa.binary())])
_SHARD_SQL = "ids array<array<long>>, vectors binary, keys binary, order binary"


def directions(dim: int, trees: int, length: int, width: int, seed: int) -> np.ndarray:
    """(trees, length, dim, width): orthogonal directions of every symbol."""
    rng = np.random.default_rng(seed)
    out = np.linalg.qr(rng.normal(size=(trees * length, dim, min(width, dim))))[0]
    return out.reshape(trees, length, dim, -1).astype(np.float32)


def hashed(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(trees, rows) strings, the first symbol in the highest bits."""
    trees, length, dim, width = planes.shape
    bits = (2 * width - 1).bit_length()
    unit = (vectors / np.sqrt((vectors * vectors).sum(1))[:, None]).astype(np.float32)
    out = np.zeros((trees, len(unit)), np.uint64)
    for t in range(trees):
        seen = (unit @ planes[t].transpose(1, 0, 2).reshape(dim, length * width)).reshape(len(unit), length, width)
        most = np.abs(seen).argmax(2)
        symbol = 2 * most + (np.take_along_axis(seen, most[:, :, None], 2)[:, :, 0] > 0)
        for k in range(length):
            out[t] = out[t] << np.uint64(bits) | symbol[:, k].astype(np.uint64)
    return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; the cosine is the same to the last bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0.0))[1][:, None])


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row in one order of summation, so equal rows have equal results."""
    return (vectors * query).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * math.sqrt(float((query * query).sum())))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of up to `dim` components; missing ones are 0."""
    flat, edge = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    size = np.diff(edge)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(edge[:-1] - edge[0], size)] = flat
    return out


def _index(dim: int, trees: int, length: int, width: int, seed: int):
    def run(batches):
        planes, held, rows = None, [], 0

        def flush():
            vectors = np.concatenate([_matrix(b.column("vector"), dim) for b in held])
            ids = pa.concat_arrays([b.column("ids") for b in held])
            keys = hashed(scaled(vectors), planes)
            order = np.argsort(keys, axis=1, kind="stable").astype(np.uint32)
            keys = np.take_along_axis(keys, order.astype(np.int64), 1)
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in (vectors, keys, order))], schema=_SHARD)

        for batch in batches:
            planes = directions(dim, trees, length, width, seed) if planes is None else planes
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows * dim * 8 >= SHARD_BYTES:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    return run


def _usable(vector: Column) -> Column:
    """Not null or empty, all components finite, one of them not 0."""
    inf = float("inf")
    return (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < inf)) & F.exists(vector, lambda x: x != 0)


def met(keys: np.ndarray, wanted: np.ndarray, length: int, bits: int, enough: int) -> list[list[tuple[int, int, int]]]:
    """(tree, begin, end) ranges of sorted entries for every query: the longest prefixes, then all trees one symbol up, until `enough` entries are met.

    keys: (trees, rows), sorted; wanted: (trees, queries).  At depth 0 a range is the whole tree, so at most all rows are met.
    """
    trees, n = keys.shape
    low, high = (np.zeros((length + 1, trees, wanted.shape[1]), np.int64) for _ in range(2))
    for depth in range(length + 1):
        shift = np.uint64(bits * (length - depth))
        for t in range(trees):
            begin = wanted[t] >> shift << shift
            low[depth, t] = np.searchsorted(keys[t], begin, "left")
            high[depth, t] = np.searchsorted(keys[t], begin | ((np.uint64(1) << shift) - np.uint64(1)), "right")
    size = high - low  # falls with depth
    out = []
    for q in range(wanted.shape[1]):
        for depth in range(length, -1, -1):
            own = size[depth, :, q]
            deeper = size[depth + 1, :, q] if depth < length else np.zeros(trees, np.int64)
            after = deeper.sum() + np.cumsum(own - deeper)  # entries when so many trees have come up
            if after[-1] >= enough or not depth:
                last = min(int(np.searchsorted(after, enough)), trees - 1)
                at = [depth if t <= last else depth + 1 for t in range(trees)]
                out.append([(t, int(low[a, t, q]), int(high[a, t, q])) for t, a in enumerate(at) if a <= length and low[a, t, q] < high[a, t, q]])
                break
    return out


def _nearest(held, dim: int, k: int, trees: int, length: int, width: int, seed: int, entries: float):
    def run(batches):
        names, flat = held.value
        queries = np.frombuffer(flat).reshape(len(names), dim)
        wanted = hashed(queries, directions(dim, trees, length, width, seed)) if len(names) else np.zeros((trees, 0), np.uint64)
        bits = (2 * min(width, dim) - 1).bit_length()
        best: list[list[tuple[float, int]]] = [[] for _ in names]
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("ids")[r].as_py()
                n = len(ids)
                vectors = scaled(np.frombuffer(batch.column("vectors")[r].as_buffer()).reshape(n, dim))
                keys = np.frombuffer(batch.column("keys")[r].as_buffer(), np.uint64).reshape(trees, n)
                order = np.frombuffer(batch.column("order")[r].as_buffer(), np.uint32).reshape(trees, n)
                for q, ranges in enumerate(met(keys, wanted, length, bits, math.ceil(entries * n))):
                    seen = np.zeros(n, bool)
                    for t, a, b in ranges:
                        seen[order[t, a:b]] = True
                    found = np.flatnonzero(seen)
                    scores = cosines(vectors[found], queries[q])
                    if len(found) > k + 1:  # one of them may be the query itself
                        bar = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                        found, scores = found[scores >= bar], scores[scores >= bar]
                    new = [(-s, i) for f, s in zip(found.tolist(), scores.tolist()) for i in ids[f] if i != names[q]]
                    best[q] = sorted(best[q] + new)[:k]
        rows = [(names[q], i, -s) for q, own in enumerate(best) for s, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


def index(vectors: DataFrame, dim: int, k: int, shards: int, trees: int, length: int, width: int, seed: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Shards of sorted hash strings over all usable vectors; a row is one vector with the k + 1 smallest ids that have it."""
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector")).where("id is not null").where(_usable(F.col("vector")))
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = first.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return classes.repartition(shards, F.xxhash64("vector")).mapInArrow(_index(dim, trees, length, width, seed), _SHARD_SQL)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = 192, length: int = 6, width: int = 16, least: int = 2000, share: float = 0.15, seed: int = 1,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of all other rows for every query, by cosine in doubles, ties by smaller id.

    A query meets `least` + `share` * n of the n different vectors' entries in the trees, dealt over the shards by their size.
    Queries are rows of the same columns; a row with the query's id is never its answer.

    Edges: null, empty and zero vectors and those with null or non-finite components take no part, nor do null ids; vectors of fewer components than
    the longest count as followed by zeros; copies are all candidates; a repeated query id searches with the smallest of its vectors; empty tables give no rows.
    """
    if length * (2 * width - 1).bit_length() > 63:
        raise ValueError("a hash string has at most 63 bits")
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, rows = vectors.where(_usable(F.col(f"`{vector_col}`"))).agg(F.max(F.size(F.col(f"`{vector_col}`"))), F.count(F.lit(1))).first()
    if not rows:
        return empty
    shards = max(shuffle_partitions(spark), -(-rows * dim * 8 // SHARD_BYTES))
    forest = durable(index(vectors, dim, k, shards, trees, length, width, seed, id_col, vector_col))
    n = forest.agg(F.sum(F.size("ids"))).first()[0]
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") + F.lit(0.0))
    asked = queries.select(F.col(f"`{id_col}`").cast("long").alias("q"), vector.alias("v")).where("q is not null").where(_usable(F.col("v"))).groupBy("q").agg(F.min("v").alias("v"))
    parts = max(1, -(-asked.count() * dim * 8 // QUERY_BYTES))
    out = None
    for part in range(parts):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).orderBy("q").toArrow()
        matrix = _matrix(block.column("v").combine_chunks(), max(dim, 1)) if block.num_rows else np.zeros((0, dim))
        held = spark.sparkContext.broadcast((block.column("q").to_pylist(), scaled(matrix).tobytes() if block.num_rows else b""))
        some = forest.mapInArrow(_nearest(held, dim, k, trees, length, width, seed, (least + share * n) / n), "query_id long, vec_id long, score double")
        out = some if out is None else out.unionByName(some)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
