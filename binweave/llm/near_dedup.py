"""Near duplicates by a chosen-path set similarity join on word shingles.

1. Every document becomes its shingle set's fingerprint, size and a sketch of `_COORDINATES` minwise tokens.  Documents with
   one set are one class; only classes are joined, so copies cost nothing more.
2. `trees` independent trees: a class enters one node per tree by a minwise token; nodes of more than `limit` classes branch,
   each class following one or two further tokens chosen by the node's path, `depth` levels down.
3. Classes in a small node are compared exhaustively (with sizes and sketch bits first), and links are confirmed on full sets: first one
   candidate per class, then all candidates that still join different components.
4. Nodes still large at the last level hold families of near copies.  The classes of such a node are dealt into blocks, and every two
   blocks meet in one task, which compares all pairs that are not in one component yet (`_compare`): on sizes and sketch bits, then on the
   full sets.  What is linked there is one component at once, so a family of near copies costs little, and no pair is left out.

Components come from alternating large-star and small-star steps.

Two sets at the threshold stay together in a tree of 4 levels with probability 0.51 (a token agrees with 0.8; a quarter of the nodes have a
second branch), so a pair escapes 16 trees with probability 1e-5, and 24 with 3e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import durable, small_batches
from ._text import U, mix64, shingles, slices, spread, utf8, word_hashes

_COORDINATES = 128
_MULTIPLIERS = mix64(np.arange(1, _COORDINATES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_OFFSETS = mix64(np.arange(1, _COORDINATES + 1, dtype=U) * U(0xD1B54A32D192ED03))
_LAST = (1 << 63) - 1
#: Classes, and bytes of their sets, in a block of a large node.
_ROWS, _BYTES = 2048, 16 << 20
#: Sketch bits in which two sets at the threshold may differ: 12.8 are expected, give or take 3.4.
_DIFFER = 32


def minwise(items: np.ndarray) -> np.ndarray:
    """The smallest hash of the items under each of the coordinates' functions."""
    best = np.full(_COORDINATES, ~U(0))
    for a in range(0, len(items), 1024):
        np.minimum(best, (items[None, a : a + 1024] * _MULTIPLIERS[:, None] + _OFFSETS[:, None]).min(1), out=best)
    return (best >> U(32)).astype(np.uint32)


def fingerprint(items: np.ndarray) -> bytes:
    """128 bits of a set."""
    a, b = mix64(items), mix64(items ^ U(0x5851F42D4C957F2D))
    return np.array([a.sum(dtype=U), b.sum(dtype=U)]).tobytes()


def _sets(column, n: int):
    data, offsets = utf8(column)
    for i, j in slices(offsets, 1 << 19):
        hashes, at, _, _ = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        yield from shingles(hashes, at, n)


def _sketches(n: int):
    def run(batches):
        for batch in batches:
            sizes, prints, sketches, low, high = [], [], [], [], []
            for items in _sets(batch.column("text"), n):
                sizes.append(len(items))
                if not len(items):
                    prints.append(None)
                    sketches.append(np.zeros(_COORDINATES, np.int32))
                    low.append(0)
                    high.append(0)
                    continue
                least = minwise(items)
                prints.append(fingerprint(items))
                sketches.append(least.view(np.int32))
                bits = np.packbits((least & 1).astype(np.uint8)).view(np.int64)
                low.append(bits[0])
                high.append(bits[1])
            flat = pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sketches) + 1, dtype=np.int32) * _COORDINATES), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), lists, pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["id", "n", "f", "sketch", "low", "high"]
            )

    return run


def _step(node: Column, sketch: Column, branch: int) -> Column:
    """The child that a class takes from a node: the path's hash chooses the token."""
    at = F.pmod(F.xxhash64(node, F.lit(branch)), F.lit(_COORDINATES)).cast("int") + 1
    return F.xxhash64(node, at, F.element_at(sketch, at))


def _nodes(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two classes or more, and the nodes' sizes."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return durable(rows.join(sizes, "node"))


def _likely(df: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches leave possible; the smaller set has `share` % of the larger at least."""
    differ = F.bit_count(F.col("a_low").bitwiseXOR(F.col("b_low"))) + F.bit_count(F.col("a_high").bitwiseXOR(F.col("b_high")))
    fit = (100 * F.least("a_n", "b_n") >= share * F.greatest("a_n", "b_n")) & (differ <= _DIFFER)
    ends = F.col("a_f") < F.col("b_f")
    return df.where(fit & (F.col("a_f") != F.col("b_f"))).select(F.when(ends, F.col("a_f")).otherwise(F.col("b_f")).alias("a"), F.when(ends, F.col("b_f")).otherwise(F.col("a_f")).alias("b"))


def candidates(classes: DataFrame, trees: int, limit: int, depth: int, share: int, family_trees: int) -> tuple[DataFrame, DataFrame | None]:
    """Distinct pairs (a, b) of classes to compare, and (node, f) of the nodes of the first `family_trees` trees that stayed large."""
    slim = classes.select("f", "n", "low", "high")
    start = F.explode(F.array(*(F.lit(t).cast("byte") for t in range(trees)))).alias("t")
    rows = classes.select("f", "sketch", start).select("f", _step(F.col("t").cast("long"), F.col("sketch"), 7).alias("node"), "t")
    pairs: DataFrame | None = None
    families: DataFrame | None = None
    for level in range(1, depth + 1):
        held = _nodes(rows)
        small = held.where(F.col("c") <= limit).select("node", "f").join(slim, "f")
        a, b = (small.select("node", *(F.col(c).alias(f"{s}_{c}") for c in ("f", "n", "low", "high"))) for s in "ab")
        # cut at each level: the driver plans and runs the joins of one level at a time
        found = durable(_likely(a.join(b, "node").where(F.col("a_f") < F.col("b_f")), share))
        pairs = found if pairs is None else pairs.unionByName(found)
        large = held.where(F.col("c") > limit)
        if large.isEmpty():
            break
        if level < depth:
            more = large.select("f", "node", "t").join(classes.select("f", "sketch"), "f")
            second = F.when(F.pmod(F.xxhash64("node", F.lit(99)), F.lit(4)) == 0, _step(F.col("node"), F.col("sketch"), 2))
            child = F.explode(F.array_compact(F.array(_step(F.col("node"), F.col("sketch"), 1), second)))
            rows = more.select("f", child.alias("node"), "t").distinct()
        else:
            families = large.where(F.col("t") < family_trees).select("node", "f")
    return pairs.distinct(), families


def _packed_sets(n: int):
    def run(batches):
        for batch in batches:
            wanted = batch.column("f").to_pylist()
            out = [(f, items.tobytes()) for f, items in zip(wanted, _sets(batch.column("text"), n)) if len(items) and fingerprint(items) == f]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.binary()), pa.array([s for _, s in out], pa.binary())], ["f", "items"])

    return run


def _confirm(share: int):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("a_items"), batch.column("b_items"))):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if 100 * both >= share * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("f").alias("b"), F.col("items").alias("b_items")), "b").join(sets.select(F.col("f").alias("a"), F.col("items").alias("a_items")), "a")
    return both.mapInArrow(_confirm(share), "a binary, b binary").distinct()


def _compare(share: int):
    """Links (a, b) between the components that a task finds linked in a block, or between two blocks: one per class at most."""
    def run(key, table):
        one = key[1].as_py() == key[2].as_py()
        side = table.column("side").to_numpy()
        n, low, high = table.column("n").to_numpy(), *(table.column(c).to_numpy().view(U) for c in ("low", "high"))
        names = table.column("f").combine_chunks()
        _, label = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)
        # the sets as numbers of a vocabulary of their own
        raw = [np.frombuffer(x.as_buffer(), U) for x in table.column("items").combine_chunks()]
        size = np.array([len(x) for x in raw])
        vocabulary, tokens = np.unique(np.concatenate(raw), return_inverse=True)
        begin, mark = np.cumsum(size) - size, np.zeros(len(vocabulary), bool)
        before = label.copy()
        for i in range(len(n)) if one else np.flatnonzero(side == 0):
            j = np.arange(i + 1, len(n)) if one else np.flatnonzero(side == 1)
            j = j[label[j] != label[i]]
            j = j[(100 * np.minimum(n[j], n[i]) >= share * np.maximum(n[j], n[i])) & (np.bitwise_count(low[j] ^ low[i]) + np.bitwise_count(high[j] ^ high[i]) <= _DIFFER)]
            if not len(j):
                continue
            mark[tokens[begin[i] : begin[i] + size[i]]] = True
            both = np.add.reduceat(mark[tokens[spread(begin[j], size[j])]], np.cumsum(size[j]) - size[j], dtype=np.int64)
            mark[tokens[begin[i] : begin[i] + size[i]]] = False
            j = j[100 * both >= share * (n[i] + n[j] - both)]
            if len(j):
                label[np.isin(label, label[j])] = label[i]
        # a class that has moved is linked with the first of its new component
        first = np.zeros(label.max() + 1, np.int64)
        first[label[::-1]] = np.arange(len(label))[::-1]
        of = np.zeros(before.max() + 1, np.int64)  # one class speaks for each former component
        of[before[::-1]] = np.arange(len(label))[::-1]
        moved = of[np.unique(before)]
        moved = moved[first[label[moved]] != moved]
        return pa.table([names.take(pa.array(first[label[moved]])), names.take(pa.array(moved))], ["a", "b"])

    return run


def _within(families: DataFrame, classes: DataFrame, sets: DataFrame, roots: DataFrame, share: int) -> DataFrame:
    """Links (a, b) that join all components which pairs of the families' nodes link."""
    rows = families.join(classes.select("f", "n", "low", "high"), "f").join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    parts = rows.groupBy("node").agg(F.greatest(F.ceil(F.count(F.lit(1)) / _ROWS), F.ceil(F.sum("n") * 8 / _BYTES)).cast("int").alias("parts"), F.countDistinct("root").alias("roots")).where("roots > 1").drop("roots")
    own = F.pmod(F.xxhash64("f", "node"), F.col("parts")).cast("int").alias("own")
    dealt = rows.join(parts, "node").select("node", "f", "root", "n", "low", "high", own, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "f", "root", "n", "low", "high").join(sets, "f")
    return dealt.groupBy("node", "i", "j").applyInArrow(_compare(share), "a binary, b binary")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large-star and small-star steps."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            moved = near.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            near = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            least = near.groupBy("u").agg(F.min("v").alias("m"))
            moved = near.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        moved = moved.where(F.col("a") != F.col("b"))
        return moved if large else moved.distinct()  # the small step that follows makes them distinct

    edges, last = durable(edges), None
    for _ in range(rounds):
        edges = durable(star(star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == last:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
        last = now
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def _between(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Links between the roots of their ends, the smaller root first; nodes without a root are their own."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    return ends.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) when links (a, b) join their components."""
    top = components(_between(roots, links)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    single = top.select(F.col("root").alias("node"), F.col("root")).join(roots.select("node"), "node", "left_anti")
    return roots.unionByName(single).join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def _ancestors(links: DataFrame, jumps: int = 3) -> DataFrame:
    """(node, root): an ancestor up to 2**jumps steps up for links (a, b) with one a per b: never outside the node's component."""
    up = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(jumps):
        up = durable(up.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
    return up


def near_duplicates(docs: DataFrame, n: int = 5, share: int = 80, trees: int = 24, limit: int = 16, depth: int = 4, family_trees: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked, directly or through others, by a Jaccard similarity of `share` % or more of their n-word shingle sets.

    Words are lower-cased (A-Z) runs of characters other than space and 0x09-0x0D; a text of fewer than n words is one shingle.
    component_id is the smallest doc_id of the component; kept marks the row that has it.

    Edges: null and empty texts have no shingles and are linked with nothing; a very long text counts whole; a null id is the largest, and a component
    of null ids only has the null id (its rows are kept); rows that repeat an id are kept or dropped together; every input row gives one row; other columns of the input don't matter.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = durable(own.mapInArrow(_sketches(n), "id long, n long, f binary, sketch array<int>, low long, high long"))
    key = F.coalesce("id", F.lit(_LAST))
    classes = durable(rows.where("f is not null").groupBy("f").agg(F.min(key).alias("rep"), *(F.first(c).alias(c) for c in ("n", "sketch", "low", "high"))))
    rows = rows.select("id", "n", "f")
    pairs, families = candidates(classes, trees, limit, depth, share, family_trees)
    pairs = durable(pairs)
    slim = classes.select("f", "n", "low", "high")
    members = pairs.select(F.col("a").alias("f")).unionByName(pairs.select(F.col("b").alias("f")))
    if families is not None:
        large = durable(families.select("f").distinct())
        members = members.unionByName(large)
    members = members.distinct().join(classes.select("f", "rep"), "f")
    sets = durable(own.withColumn("rep", key).join(members, "rep").select("f", "text").mapInArrow(_packed_sets(n), "f binary, items binary"))
    # one candidate per class first: most others then fall inside a component
    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    links = durable(confirmed(first.select("a", "b"), sets, share))
    roots = _ancestors(links)
    part = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    open_ = pairs.join(part("a"), "a", "left").join(part("b"), "b", "left")
    open_ = open_.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b").join(first, ["a", "b"], "left_anti")
    roots = durable(components(links.unionByName(confirmed(open_, sets, share))))
    if families is not None:
        roots = durable(_merged(roots, durable(_within(families, classes, sets, roots, share))))
    named = classes.select("f", "rep").join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    named = named.join(least, "root").select("f", "least")
    out = rows.join(named, "f", "left")
    component = F.when(F.col("f").isNull(), F.col("id")).when(F.col("least") < _LAST, F.col("least"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
