"""Benchmark decontamination: BM25 over test items as an inverted index with block maxima, queried by every training passage.

A passage retrieves all items that score at least `threshold` of what the item scores against itself.  Items lie in
blocks; a term keeps its largest impact in each block it occurs in.  Each item's most frequent terms, as many as stay
below the threshold together, are not looked up: a passage that reaches the threshold has another term of the item too.  The
looked-up terms' block maxima, plus the most that the others can give an item of the block, bound its scores, and just the
blocks whose bound reaches the threshold are scored exactly.  What is retrieved is then verified: the item's 5-word shingles, its question's words and its answer's words must occur in
the passage.

The index grows with the benchmark only.  Benchmarks of more than `max_items` items are searched in several passes; frequencies, the mean
length and the passages' length are those of all items in each, so the number of passes changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable, small_batches
from ._text import U, prefix, range_hash, slices, spread, term_hashes, utf8

K1, B = 1.2, 0.75
BLOCK = 4


@dataclass
class Index:
    ids: np.ndarray
    terms: np.ndarray  # sorted hashes
    start: np.ndarray  # postings of term i: start[i]:start[i + 1]
    item: np.ndarray
    weight: np.ndarray  # share of the item's own score
    light: np.ndarray  # terms that no item is looked up by
    rest: np.ndarray  # per block: the largest share of an item's score that its light terms have; below the threshold
    block_start: np.ndarray
    block: np.ndarray
    block_weight: np.ndarray
    words: list  # per item: terms in order


@dataclass
class Statistics:
    """Of all items, in whatever parts they are searched."""

    n: int
    mean: float
    terms: np.ndarray  # sorted hashes, those of a part's items at least
    df: np.ndarray


def statistics(texts: list[str]) -> Statistics:
    terms, at = term_hashes(*utf8(pa.array(texts, pa.large_string())))
    pairs = np.unique(np.stack([terms, np.repeat(np.arange(len(texts)), np.diff(at)).astype(U)]), axis=1) if len(terms) else np.zeros((2, 0), U)
    found, df = np.unique(pairs[0], return_counts=True)
    return Statistics(len(texts), max(1.0, len(terms) / max(1, len(texts))), found, df)


def build(ids: list[int], texts: list[str], threshold: float, of_all: Statistics | None = None) -> Index:
    of_all = of_all or statistics(texts)
    column = pa.array(texts, pa.large_string())
    terms, at = term_hashes(*utf8(column))
    owner = np.repeat(np.arange(len(ids)), np.diff(at))
    order = np.lexsort((owner, terms))
    t, o = terms[order], owner[order]
    new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (o[1:] != o[:-1]))) if len(t) else np.zeros(0, np.int64)
    tf, t, o = np.diff(np.append(new, len(t))), t[new], o[new]
    vocabulary, first, postings = np.unique(t, return_index=True, return_counts=True)
    n, length, mean = len(ids), np.diff(at), of_all.mean
    df = of_all.df[np.searchsorted(of_all.terms, vocabulary)]
    idf = np.log1p((of_all.n - df + 0.5) / (df + 0.5))
    score = np.repeat(idf, postings) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[o] / mean))
    own = np.bincount(o, score, n)
    weight = score / own[o] if len(o) else score
    # an item's postings from its most frequent term on: light while their weights stay below the threshold together
    common = np.repeat(df, postings)
    by_item = np.lexsort((t, -common, o))
    sums = np.cumsum(weight[by_item])
    begin = np.searchsorted(o[by_item], np.arange(n))
    sums -= np.append(0.0, sums)[begin][o[by_item]] if len(o) else 0.0
    posting_light = np.zeros(len(o), bool)
    posting_light[by_item] = (sums < threshold - 1e-6) & (common[by_item] > max(2, of_all.n // 20))
    rest = np.zeros(n // BLOCK + 1)
    np.maximum.at(rest, np.arange(n) // BLOCK, np.bincount(o, weight * posting_light, n))
    light = np.logical_and.reduceat(posting_light, first) if len(first) else np.zeros(0, bool)
    start = np.append(first, len(t))
    # only postings that are looked up make blocks
    looked = np.flatnonzero(~posting_light)
    lt, block, lw = t[looked], o[looked] // BLOCK, weight[looked]
    edge = np.flatnonzero(np.append(True, (lt[1:] != lt[:-1]) | (block[1:] != block[:-1]))) if len(lt) else np.zeros(0, np.int64)
    terms_of = lt[edge]
    block_start = np.append(np.searchsorted(terms_of, vocabulary), len(edge))
    return Index(np.array(ids, np.int64), vocabulary, start, o, weight, light, rest, block_start, block[edge], np.maximum.reduceat(lw, edge) if len(edge) else np.zeros(0), [terms[a:b] for a, b in zip(at[:-1], at[1:])])


def _grams(terms: np.ndarray, n: int = 5) -> np.ndarray:
    if not len(terms):
        return terms
    n = min(n, len(terms))
    return np.unique(range_hash(prefix(terms), np.arange(len(terms) - n + 1), np.arange(n, len(terms) + 1)))


def _share(part: np.ndarray, whole: np.ndarray) -> float:
    return float(np.isin(part, whole).mean()) if len(part) else 1.0


def search(index: Index, terms: np.ndarray, at: np.ndarray, size: int, threshold: float):
    """(text, first word, item, score) of the passages of texts that reach the threshold."""
    vocabulary = index.terms
    if not len(terms) or not len(vocabulary):
        return
    where = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    hit = np.flatnonzero((vocabulary[where] == terms) & ~index.light[where])
    if not len(hit):
        return
    half = size // 2
    text = np.searchsorted(at, hit, "right") - 1
    # passages start at every half of `size` words; a word is in two of them
    offset = hit - at[text]
    count = np.maximum(1, -(-(np.diff(at) - half) // half))
    base = np.concatenate([[0], np.cumsum(count)])
    later = np.minimum(offset // half, count[text] - 1)
    passage = np.concatenate([base[text] + later, (base[text] + later - 1)[(later > 0) & (offset < (later + 1) * half)]])
    term = np.concatenate([where[hit], where[hit][(later > 0) & (offset < (later + 1) * half)]])
    pairs = np.unique(passage * len(vocabulary) + term)
    passage, term = pairs // len(vocabulary), pairs % len(vocabulary)
    blocks = index.block_start[term + 1] - index.block_start[term]
    rows = spread(index.block_start[term], blocks)
    n_blocks = len(index.ids) // BLOCK + 1
    keys, slot = np.unique(np.repeat(passage, blocks) * n_blocks + index.block[rows], return_inverse=True)
    bound = np.bincount(slot, index.block_weight[rows])
    for key in keys[bound + index.rest[keys % n_blocks] >= threshold]:
        p, b = divmod(int(key), n_blocks)
        d = int(np.searchsorted(base, p, "right")) - 1
        first = (p - int(base[d])) * half
        lo, hi = at[d] + first, min(at[d] + first + size, at[d + 1])
        own = np.unique(where[lo:hi][vocabulary[where[lo:hi]] == terms[lo:hi]])
        counts = index.start[own + 1] - index.start[own]
        at_posting = spread(index.start[own], counts)
        at_posting = at_posting[index.item[at_posting] // BLOCK == b]
        scores = np.bincount(index.item[at_posting] - b * BLOCK, index.weight[at_posting], BLOCK)
        for i in np.flatnonzero(scores >= threshold):
            yield d, first, int(b * BLOCK + i), float(scores[i]), terms[lo:hi]


def verified(index: Index, item: int, passage: np.ndarray, least: tuple[float, float, float]) -> tuple[float, float, float] | None:
    """Overlap of shingles, question and answer (the last quarter of the item) with the passage, if all suffice."""
    own = index.words[item]
    cut = max(1, len(own) - max(1, len(own) // 4))
    found = (_share(_grams(own), _grams(passage, min(5, len(own)))), _share(np.unique(own[:cut]), passage), _share(np.unique(own[cut:]), passage))
    return found if all(f >= x for f, x in zip(found, least)) else None


def _find(held, size: int, threshold: float, least: tuple):
    def run(batches):
        index = held.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out: list[dict] = [{} for _ in range(batch.num_rows)]
            for i, j in slices(offsets):
                terms, at = term_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for d, first, item, score, passage in search(index, terms, at, size, threshold):
                    if found := verified(index, item, passage, least):
                        old = out[i + d].get(int(index.ids[item]))
                        if not old or score > old["score"]:
                            out[i + d][int(index.ids[item])] = {"item_id": int(index.ids[item]), "first_word": first, "score": score, "shingles": found[0], "question": found[1], "answer": found[2]}
            hits = pa.array([sorted(h.values(), key=lambda x: x["item_id"]) for h in out], HITS)
            yield pa.RecordBatch.from_arrays([batch.column("row"), hits], ["row", "hits"])

    return run


HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("score", pa.float64()), ("shingles", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
_SQL = "array<struct<item_id:bigint,first_word:int,score:double,shingles:double,question:double,answer:double>>"


def _item_terms(batches):
    """An item's number of terms under NULL, and its distinct terms."""
    for batch in batches:
        data, offsets = utf8(batch.column("t"))
        for i, j in slices(offsets):
            terms, at = term_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                own = np.unique(terms[a:b]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(own)]), pa.array(np.append(b - a, np.ones(len(own), np.int64)))], ["term", "n"])


def find_leaks(
    docs: DataFrame, items: DataFrame, threshold: float = 0.5, least: tuple[float, float, float] = (0.5, 0.6, 0.5), passage_words: int = 128, max_items: int = 50_000,
    text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """All columns of `docs`, then hits (item_id, first_word, score, shingles, question, answer; best passage per item) and contaminated.

    Passages have `passage_words` words, twice the longest item's if that is more, and start at every half of that, so an item that
    was copied lies whole in one of them.  `least`: shares of the item's 5-word shingles, question words and answer words that the passage must have.

    Edges: null and empty texts have no hits; items without words are never found, items with a null id are left out; an item whose text is
    repeated is found under each of its ids; a text of any length is read whole, in passages; repeated document rows are judged each; input columns named hits or contaminated are replaced; an empty benchmark leaves all clean.
    """
    small_batches(docs.sparkSession, 2000)
    kept = [c for c in docs.columns if c.lower() not in ("hits", "contaminated")]
    own = items.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).where("i is not null")
    counted = durable(own.mapInArrow(_item_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("items"), F.max("n").alias("most")))
    total = counted.where("term is null").first()
    n, words, longest = (total["items"], total["df"], total["most"]) if total else (0, 0, 0)
    size = max(passage_words, 2 * longest)
    parts = max(1, -(-n // max_items))
    out = docs.select(F.struct(*kept).alias("row"), F.lit(None).cast(_SQL).alias("hits")) if not kept else docs.select(F.struct(*kept).alias("row"), F.array().cast(_SQL).alias("hits"))
    for part in range(parts):
        some = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        rows = some.orderBy("i", "t").collect()
        held_terms = some.mapInArrow(_item_terms, "term long, n long").where("term is not null").select("term").distinct()
        own_counts = counted.join(held_terms, "term", "left_semi").select("term", "df").toArrow()
        terms, df = own_counts.column("term").to_numpy().view(U), own_counts.column("df").to_numpy()
        order = np.argsort(terms)
        of_all = Statistics(n, max(1.0, words / max(1, n)), terms[order], df[order])
        held = docs.sparkSession.sparkContext.broadcast(build([r["i"] for r in rows], [r["t"] for r in rows], threshold, of_all))
        source = out.select(F.struct("row", "hits").alias("row"), F.col(f"row.`{text_col}`").cast("string").alias("text"))
        schema = f"row {source.schema['row'].dataType.simpleString()}, hits {_SQL}"
        out = source.mapInArrow(_find(held, size, threshold, least), schema).select("row.row", F.concat("row.hits", "hits").alias("hits"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), F.array_sort("hits").alias("hits"), (F.size("hits") > 0).alias("contaminated"))
