"""Periodic runs of words: the word numbers of a text compared with themselves at every lag.

A run is a stretch of words that repeats with a smallest period q, at least `exponent` times and `least` words long, which no
neighbouring word extends.  At lag q it is a stretch of words equal to those q further on, max(least, exponent * q) - q of them at
least.  Lags below 8 are compared word by word.  At a larger lag such a stretch covers q - 3 pairs of equal neighbouring pairs in a
row, so every (q - 3)-th place is compared first, and only the surroundings of places that agree are compared in full: all
lags of a text of n words cost n log n comparisons, and none is left out.

Texts of more than `long` bytes are dealt out as (text, range of lags), so one long text keeps several tasks busy; the ranges' runs
are put together by text.  All others are one range each and need no shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches
from ._text import SOLID_WORD, coded, slices, spread, utf8

NEAR = 8  # lags below are compared everywhere
CHUNK = 2_000_000  # places compared at a time
RUNS = "array<struct<start:long,length:long,period:long>>"


def _stretches(equal: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of at least `need` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= need
    return starts[keep], ends[keep]


def _smallest_period(w: np.ndarray, q: int) -> int:
    """The smallest period of a stretch that has period q and at least 2 * q words: it divides q."""
    left, d = q, 2
    while left > 1:
        if d * d > left:
            d = left
        if left % d:
            d += 1
            continue
        left //= d
        p = q // d
        if np.array_equal(w[:-p], w[p:]):
            q = p
    return q


def _places(w: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(text, lag, place) arrays, by text and lag, of the sampled places where four words agree with those a lag further on and so do words half a lag away."""
    pair = w[:-1] * (int(w.max(initial=0)) + 1) + w[1:]
    size = np.diff(at)
    texts = np.repeat(np.arange(len(size)), np.maximum(0, high - low))
    lags = spread(low, np.maximum(0, high - low))
    count = np.maximum(0, (size[texts] - lags - 4) // (lags - 3) + 1)
    edge = np.concatenate([[0], np.cumsum(count)])
    i = 0
    while i < len(lags):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + CHUNK, "right")) - 1)
        own = np.repeat(np.arange(i, j), count[i:j])
        q = lags[own]
        s = (np.arange(len(own)) - (edge[own] - edge[i])) * (q - 3) + at[texts[own]]
        hit = pair[s] == pair[s + q]
        own, q, s = own[hit], q[hit], s[hit]
        hit = pair[s + 2] == pair[s + 2 + q]
        own, q, s = own[hit], q[hit], s[hit]
        for part in (2, 4):  # what is long enough goes on for half a lag to either side
            far, begin, end = q // part, at[texts[own]], at[texts[own] + 1]
            after, before = s + far - 1, s - far
            right = (after + q < end) & (w[np.minimum(after, len(w) - 1)] == w[np.minimum(after + q, len(w) - 1)])
            left = (before >= begin) & (w[np.maximum(before, 0)] == w[np.maximum(before, 0) + q])
            hit = right | left
            own, q, s = own[hit], q[hit], s[hit]
        yield texts[own], q, s - at[texts[own]]
        i = j


def runs(w: np.ndarray, at: np.ndarray, least: int = 12, exponent: int = 2, low: np.ndarray | None = None, high: np.ndarray | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of every text, by start and period; w holds word numbers, at the texts' offsets.

    With `low` and `high` (per text) only those that show at a lag in [low, high); a run shows at its own period.
    """
    size = np.diff(at)
    low = np.ones(len(size), np.int64) if low is None else low
    high = np.minimum(size // exponent + 1, size // exponent + 1 if high is None else high)
    found: list[set] = [set() for _ in size]
    skip: list[dict] = [{} for _ in size]  # by lag: runs of a period that divides it, whose stretch is that run again

    def note(d: int, start: int, end: int, q: int) -> None:
        words = w[at[d] + start : at[d] + end]
        p = _smallest_period(words, q)
        if (start, end - start, p) not in found[d]:
            found[d].add((start, end - start, p))
            for m in range(p * (max(q, NEAR) // p), end - start - 3, p):
                if m >= NEAR:
                    skip[d].setdefault(m, []).append((start, end))

    for q in range(1, NEAR):
        equal = w[:-q] == w[q:] if len(w) > q else np.zeros(0, bool)
        ends = at[1:] - q  # a text's last q words have no partner in it
        for back in range(q):
            x = ends + back
            x = x[(x >= 0) & (x < len(equal))]
            equal[x] = False
        for a, b in zip(*_stretches(equal, max(least - q, (exponent - 1) * q))):
            d = int(np.searchsorted(at, a, "right")) - 1
            if low[d] <= q < high[d]:
                note(d, int(a - at[d]), int(b - at[d]) + q, q)
    if not len(w):
        return [[] for _ in size]
    for texts, lags, places in _places(w, at, np.maximum(low, NEAR), high):
        if not len(texts):
            continue
        step = lags - 3
        new = np.flatnonzero(np.append(True, (texts[1:] != texts[:-1]) | (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + step[:-1])))
        for d, q, a, b in zip(texts[new].tolist(), lags[new].tolist(), places[new].tolist(), places[np.append(new[1:], len(texts)) - 1].tolist()):
            if any(s <= a and b + 4 + q <= e for s, e in skip[d].get(q, ())):
                continue
            # filters may have split a stretch's places, so go on while words agree
            begin, n, x = int(at[d]), int(size[d]), w[at[d] : at[d + 1]]
            i, j = max(0, a - (q - 3)), min(n - q, b + q + 1)
            while i > 0 and x[i] == x[i + q]:
                i = max(0, i - q)
            while j < n - q and x[j - 1] == x[j - 1 + q]:
                j = min(n - q, j + q)
            for s, e in zip(*_stretches(x[i:j] == x[i + q : j + q], max(least - q, (exponent - 1) * q))):
                note(d, int(s) + i, int(e) + i + q, q)
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def _kept(n: int, own: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in own:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def _listed(each: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [r for own in each for r in own]
    struct = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(own) for own in each])]), pa.int32()), struct)


def _collapsed(w: np.ndarray, at: np.ndarray, vocabulary: list[bytes], each) -> list[bytes]:
    return [b" ".join([vocabulary[c] for c in w[a:b][_kept(b - a, own)].tolist()]) for a, b, own in zip(at[:-1].tolist(), at[1:].tolist(), each)]


def _whole(least: int, exponent: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            for i, j in slices(offsets):
                w, at, vocabulary = coded(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SOLID_WORD)
                each = runs(w, at, least, exponent)
                texts = _collapsed(w, at, vocabulary.to_pylist(), each)
                yield pa.RecordBatch.from_arrays([batch.column("_row")[i:j], pa.array(np.diff(at), pa.int64()), _listed(each), pa.array(texts, pa.binary()).cast(pa.string())], ["_row", "n_words", "runs", "collapsed"])

    return run


def _ranges(least: int, exponent: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            for i in range(batch.num_rows):
                w, at, _ = coded(data[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i], SOLID_WORD)
                lags = batch.column("_lags")[i].as_py()
                each = runs(w, at, least, exponent, np.array([lags["low"]]), np.array([lags["high"]]))
                yield pa.RecordBatch.from_arrays([batch.column("_key")[i : i + 1], _listed(each)], ["_key", "_runs"])

    return run


def _joined():
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            for i in range(batch.num_rows):
                w, at, vocabulary = coded(data[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i], SOLID_WORD)
                own = sorted({(r["start"], r["length"], r["period"]) for r in batch.column("_runs")[i].as_py() or ()}, key=lambda r: (r[0], r[2]))
                texts = _collapsed(w, at, vocabulary.to_pylist(), [own])
                yield pa.RecordBatch.from_arrays([batch.column("_row")[i : i + 1], pa.array(np.diff(at), pa.int64()), _listed([own]), pa.array(texts, pa.binary()).cast(pa.string())], ["_row", "n_words", "runs", "collapsed"])

    return run


def _lag_ranges(size: Column, factor: int) -> Column:
    """[1, 8 * factor), [8 * factor, 8 * factor**2), ...: ranges of about equal work, up to beyond half as many lags as a text of so many bytes can have words."""
    n = F.greatest(F.lit(1), F.ceil(F.log(F.greatest(size / (4.0 * NEAR), F.lit(1.0))) / math.log(factor)) + 1).cast("int")
    edge = lambda k: (F.lit(float(NEAR)) * F.pow(F.lit(float(factor)), k)).cast("long")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.when(k == 0, F.lit(1).cast("long")).otherwise(edge(k)).alias("low"), edge(k + 1).alias("high")))


def find_runs(docs: DataFrame, text_col: str = "text", least: int = 12, exponent: int = 2, long: int = 1 << 20, factor: int = 16) -> DataFrame:
    """The columns of docs with n_words, runs (start, length, period; by start, then period) and collapsed (the words that no run holds after its first period, joined by one space).

    Words are runs of characters other than space and 0x09-0x0D.  Input columns named like an output are replaced by it.

    Edges: null and empty texts have no words, no runs and an empty collapsed text; rows that repeat are judged each; texts of any length are
    read whole (those over `long` bytes in ranges of lags, `factor` times longer each); null ids and other columns are carried along; an empty table gives no rows.
    """
    if least < 2 or exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), text.alias("_text")) if own else docs.select(F.struct(F.lit(0).alias("_none")).alias("_row"), text.alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    out = f"_row {kind}, n_words long, runs {RUNS}, collapsed string"
    is_long = F.coalesce(F.octet_length("_text") > long, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_whole(least, exponent), out)
    many = rows.where(is_long).withColumn("_key", F.sha2("_text", 256))
    dealt = many.select("_key", "_text").dropDuplicates(["_key"]).select("_key", "_text", F.explode(_lag_ranges(F.octet_length("_text"), factor)).alias("_lags"))
    some = dealt.repartition(F.col("_key"), F.col("_lags.low")).mapInArrow(_ranges(least, exponent), f"_key string, _runs {RUNS}")
    some = some.groupBy("_key").agg(F.flatten(F.collect_list("_runs")).alias("_runs"))
    ranged = many.join(some, "_key", "left").select("_row", "_text", "_runs").mapInArrow(_joined(), out)
    return short.unionByName(ranged).select(*(F.col(f"_row.`{c}`").alias(c) for c in own), "n_words", "runs", "collapsed")
