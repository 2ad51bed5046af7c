"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import numbered

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """Share of letters and white space among the characters (1 for an empty text): the default quality weight."""
    n = F.length(text)
    share = 1 - F.length(F.regexp_replace(text, r"[\p{L}\s]+", "")) / F.greatest(n, F.lit(1))
    return F.coalesce(share, F.lit(1.0))


def rotating_weights(sources: list[str | None]) -> list[float]:
    """1, 2, 3, repeating, over sources in the given order."""
    return [1.0 + i % 3 for i in range(len(sources))]


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Share the sum of sizes by weight; what would exceed `most` times a source's size is reshared by weight until nothing does."""
    out, free, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if rest * weights[i] / total > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = rest * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        rest -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def mix(
    docs: DataFrame,
    weights: Callable[[list[str | None]], list[float]] = rotating_weights,
    most: float = 3.0,
    quality: Column | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """All columns of `docs`, then size, source_size, target, copies (how often the mix takes the row) and taken (= copies * size).

    Each source takes complete epochs first; the rest of its target goes to the documents with the smallest
    keys -ln(u) / quality, u a hash of seed, id and text, in order until the budget is used; the document at
    the border is taken if that comes nearer to the target.  Only the table of sources reaches the driver.

    Edges: null or empty texts have size 0; the null source is a source of its own, last; a null or
    non-positive quality counts as 1e-6; very long texts are counted whole; repeated rows draw the same key and are ordered arbitrarily among
    themselves; empty tables give no rows; input columns named like an output are replaced.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c.lower() not in new]
    spark = docs.sparkSession
    of, text = F.col(source_col).cast("string"), F.col(text_col).cast("string")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 12).cast("double") + 0.5) / float(1 << 52)
    weight = F.greatest(F.coalesce(quality if quality is not None else letter_share(text), F.lit(0.0)), F.lit(1e-6))
    # null sorts last and never equals a real source
    src = F.coalesce(F.concat(F.lit("s"), of), F.lit("z"))
    rows = docs.select(F.struct(*kept).alias("row"), word_count(text).alias("size"), src.alias("src"), (-F.log(u) / weight).alias("key"), F.col(id_col).alias("id"))
    table = rows.groupBy("src").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    table = sorted(table, key=lambda r: r["src"])
    names = [r["src"][1:] if r["src"][0] == "s" else None for r in table]
    goals = targets([r["size"] for r in table], weights(names), most)
    goal = spark.createDataFrame([(r["src"], r["size"], float(t), int(t // r["size"]) if r["size"] else 0) for r, t in zip(table, goals)], "of string, source_size long, target double, epochs long")
    goal = F.broadcast(goal) if len(table) <= 100_000 else goal
    # Whatever the weights, the log of the keys has a density below 0.26 per octave: no bucket gets a larger share of a source.
    steps = max(64, max([r["n"] for r in table], default=0) // 100_000)
    placed = numbered(rows, "src", F.floor(F.log2("key") * steps), [F.col("key"), F.col("id")], "before", F.col("size"))
    placed = placed.join(goal, F.col("src") == F.col("of"))
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = F.when((F.col("before") < left) & (2 * F.col("before") + F.col("size") <= 2 * left), 1).otherwise(0)
    placed = placed.withColumn("copies", (F.col("epochs") + extra).cast("long"))
    return placed.withColumn("taken", F.col("copies") * F.col("size")).select(*(F.col(f"row.`{c}`").alias(c) for c in kept), *new)
