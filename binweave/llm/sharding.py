"""Sharding by a k-d tree: split at distributed weighted medians along the widest metadata dimension.

The tree is found on a narrow table of (size, dimension keys); medians are exact, found by refining
16 bits of the key per pass, so that only one row per open node ever reaches the driver.  Applying the
tree is a projection; the text itself is shuffled only if the caller asks for slots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import durable, freeing, numbered, shuffle_partitions

_BITS, _ROUND = 64, 16
_CASES = 256


@dataclass(frozen=True)
class Split:
    """Rows of `node` whose key of dimension `dim` is below `cut` go to child 2*node, others to 2*node+1."""

    node: int
    dim: int
    cut: int


def order_key(part: Column, text: Column, row: Column) -> Column:
    """63-bit key: a value in [0, 1] (27 bits), then 20 bits of a hash of `text`, then 16 of `row`: equal values can be split, equal texts last."""
    value = F.floor(F.least(F.greatest(F.coalesce(part, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * F.lit(float((1 << 27) - 1))).cast("long")
    tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 44), _ROUND).bitwiseOR(F.shiftrightunsigned(F.xxhash64(text, row), 48))
    return F.shiftleft(value, 36).bitwiseOR(tie)


def _dim(number: Column, dims: list[str]) -> Column:
    out = F.col(dims[0])
    for i, name in enumerate(dims[1:], 1):
        out = F.when(number == i, F.col(name)).otherwise(out)
    return out


def kd_tree(rows: DataFrame, weight: str, dims: list[str], leaves: int, slack: float = 0.0) -> list[Split]:
    """Splits of the tree with that many leaves; `rows` has a long weight and 63-bit keys (see order_key).

    Where that is off by at most `slack` of a leaf's weight, rows that differ in the last 16 bits only (equal texts) stay together.
    """
    splits: list[Split] = []
    open_nodes = {1: leaves}
    rows = rows.select(F.col(weight).alias("_w"), *dims, F.lit(1).cast("long").alias("_node"))
    span: list[int] = []
    near: float | None = None
    while open_nodes := {k: m for k, m in open_nodes.items() if m > 1}:
        ends = [f(F.shiftright(F.col(d), 36)).alias(f"_{i}{f.__name__}") for i, d in enumerate(dims) for f in (F.min, F.max)]
        stats = {r["_node"]: r for r in rows.groupBy("_node").agg(F.sum("_w").alias("_total"), *ends).collect() if r["_node"] in open_nodes}
        width = {n: [r[f"_{i}max"] - r[f"_{i}min"] for i in range(len(dims))] for n, r in stats.items()}
        span = span or [max(1, x) for x in width.get(1, [1] * len(dims))]
        chosen = {n: max(range(len(dims)), key=lambda i: (w[i] / span[i], -i)) for n, w in width.items()}
        goal = {n: r["_total"] * (open_nodes[n] // 2) / open_nodes[n] for n, r in stats.items()}
        if not chosen:
            break
        near = slack * stats[1]["_total"] / leaves if near is None else near
        # the row key that each open node is split by; done and empty nodes drop out
        keyed = _look_up(rows, {n: (i,) for n, i in chosen.items()}, "_dim int").select("_node", "_w", _dim(F.col("_dim"), dims).alias("_key"))
        found = {n: (0, 0, 0) for n in chosen}  # high bits so far, weight before them and at them
        cut: dict[int, int] = {}
        for low in range(_BITS - _ROUND, -1, -_ROUND):
            at = {n: (high, float(goal[n] - base)) for n, (high, base, _) in found.items() if n not in cut}
            if not at:
                break
            bins = _look_up(keyed, at, "_high long, _need double").where(F.shiftright(F.shiftright("_key", low), _ROUND) == F.col("_high"))
            bins = bins.groupBy("_node", "_need", F.shiftright("_key", low).alias("_bin")).agg(F.sum("_w").alias("_w"))
            upto = F.sum("_w").over(Window.partitionBy("_node").orderBy("_bin"))
            bins = bins.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_need"))
            for r in bins.groupBy("_node").agg(F.min(F.struct("_bin", "_upto", "_w")).alias("_b")).collect():
                n, b = r["_node"], r["_b"]
                found[n] = key, before, own = b["_bin"], found[n][1] + b["_upto"] - b["_w"], b["_w"]
                inside = before + own - goal[n] <= goal[n] - before  # nearer to the goal with what lies at the median, or without?
                if not low or low == _ROUND and min(before + own - goal[n], goal[n] - before) <= near:
                    cut[n] = (key + inside) << low
        new = [Split(n, chosen[n], key) for n, key in cut.items()]
        splits += new
        rows = _step(rows, new, dims, "_node")
        open_nodes = {c: m for s in new for c, m in ((2 * s.node, open_nodes[s.node] // 2), (2 * s.node + 1, open_nodes[s.node] - open_nodes[s.node] // 2))}
    return splits


def _look_up(rows: DataFrame, values: dict[int, tuple], schema: str) -> DataFrame:
    """Rows of the given nodes with their values: by a CASE for few nodes, else by a join (as many rows as nodes)."""
    names = [x.split()[0] for x in schema.split(",")]
    if len(values) > _CASES:
        table = rows.sparkSession.createDataFrame([(n, *v) for n, v in values.items()], f"_of long, {schema}")
        return rows.join(F.broadcast(table), F.col("_node") == F.col("_of")).drop("_of")
    for i, name in enumerate(names):
        out = F.lit(None)
        for n, v in values.items():
            out = F.when(F.col("_node") == n, F.lit(v[i])).otherwise(out)
        rows = rows.withColumn(name, out)
    return rows.where(F.col("_node").isin(list(values)))


def _step(rows: DataFrame, splits: list[Split], dims: list[str], node: str) -> DataFrame:
    """One level down: by a CASE for few nodes, else by a join with the table of splits (as many rows as nodes)."""
    if len(splits) <= _CASES:
        out = F.col(node)
        for s in splits:
            out = F.when(F.col(node) == s.node, F.when(F.col(dims[s.dim]) < F.lit(s.cut), F.lit(2 * s.node)).otherwise(F.lit(2 * s.node + 1))).otherwise(out)
        return rows.withColumn(node, out.cast("long"))
    table = rows.sparkSession.createDataFrame([(s.node, s.dim, s.cut) for s in splits], "_of long, _dim int, _cut long")
    joined = rows.join(F.broadcast(table), F.col(node) == F.col("_of"), "left")
    down = 2 * F.col(node) + F.when(_dim(F.col("_dim"), dims) < F.col("_cut"), 0).otherwise(1)
    return joined.withColumn(node, F.when(F.col("_of").isNull(), F.col(node)).otherwise(down)).drop("_of", "_dim", "_cut")


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; null has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def category(value: Column) -> Column:
    """A coordinate in [0, 1) of a name; null is 0."""
    return F.coalesce(F.crc32(F.encode(value.cast("string"), "UTF-8")) / float(1 << 32), F.lit(0.0))


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, names: tuple[str, ...] = ("lang",), slack: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, then size, text_crc32, shard and slot.

    Dimensions are the size (log scale) and the columns in `names` that `docs` has.  A median may move by `slack` of a shard to keep
    equal texts (of one name) together; a group of equal texts that the even sizes don't allow to stay whole is split.  Give the number
    of shards, or `target_bytes` (shards = ceil(total / target)).

    Edges: null text has size 1 and CRC 0; a very long text counts whole; rows with null ids or names take part; rows that agree in id and
    text can't be told apart and share a shard; an empty table gives no rows; columns of the input named like
    an output column are replaced.  Shards are 0.. in the order of the leaves; slots are gapless from 0.
    """
    extra = [c for c in docs.columns if c.lower() not in ("size", "text_crc32", "shard", "slot")]
    text = F.col(text_col)
    rows = docs.select(F.struct(*extra).alias("row"), F.col(id_col).alias("id"), text_size(text).alias("size"), text_crc32(text).alias("text_crc32"), *(category(F.col(n)).alias(f"c{i}") for i, n in enumerate(n for n in names if n in docs.columns)))
    parts = [F.log2(F.col("size").cast("double")) / 40, *(F.col(c) for c in rows.columns if c[0] == "c")]
    dims = [f"k{i}" for i in range(len(parts))]
    of = F.struct("size", "text_crc32")
    rows = rows.select("row", "id", "size", "text_crc32", *(order_key(p, of, F.col("id")).alias(k) for p, k in zip(parts, dims)))
    narrow = durable(rows.select("size", *dims))
    total = narrow.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    leaves = shards or max(1, -(-(total["b"] or 0) // (target_bytes or 1 << 30)))
    with freeing(docs.sparkSession):
        splits = kd_tree(narrow, "size", dims, leaves, slack)
    level: dict[int, list[Split]] = {}
    for s in splits:
        level.setdefault(s.node.bit_length(), []).append(s)
    placed = rows.withColumn("node", F.lit(1).cast("long"))
    for _, at in sorted(level.items()):
        placed = _step(placed, at, dims, "node")
    inner = {s.node for s in splits}
    ends = sorted(({1} | {c for n in inner for c in (2 * n, 2 * n + 1)}) - inner, key=lambda n: n << (64 - n.bit_length()))
    if len(ends) <= _CASES:
        number = F.lit(0)
        for i, n in enumerate(ends):
            number = F.when(F.col("node") == n, F.lit(i)).otherwise(number)
        placed = placed.withColumn("shard", number.cast("int"))
    else:
        leaf = docs.sparkSession.createDataFrame([(n, i) for i, n in enumerate(ends)], "of long, shard int")
        placed = placed.join(F.broadcast(leaf), F.col("node") == F.col("of")).drop("of")
    even = F.shiftrightunsigned(F.xxhash64(F.lit(7), "id", "text_crc32"), 11) / float(1 << 53)
    buckets = max(shuffle_partitions(docs.sparkSession), total["n"] // (leaves * 50_000) + 1)
    out = numbered(placed, "shard", F.floor(even * buckets), [even, F.col("id"), F.col("text_crc32")], "slot")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in extra), "size", "text_crc32", "shard", "slot")
