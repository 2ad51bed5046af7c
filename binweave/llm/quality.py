"""Quality by an interpolated modified Kneser-Ney trigram model of trusted text.

All documents labelled good are training text.  Their n-grams, as numbers of words, are dealt to buckets by the word before
the last one (frequent ones in slices by the word before that), so a bucket holds whole contexts: counted there, n-grams never
meet in one place.  Occurrences in the corpus' documents go to the same buckets, in a few rounds of documents, and only a
document's sums come back.  What is broadcast grows with the vocabulary alone.
Words seen fewer than `min_count` times count as one of a few shapes (lower case, capitalised, capitals, with digits, with marks, ...).

A document is kept if its perplexity lies between two quantiles, of its own language, of all labelled good text.  Texts that the
model was trained on are judged by the half of the training text that they aren't in (halves by hash of the text, so copies stay
together).  Words that the labels tie to toxic text (markers) reject a document by themselves if it has `min_markers` of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable, freeing, shuffle_partitions, small_batches
from ._text import _BYTE, U, mix64, pack, prefix, range_hash, slices, spread, term_hashes, unpack, utf8, words

_AGAIN = U(0x414741494E)
_SHAPES = 16
#: Log probabilities are added up as whole multiples of 2^-24, so that sums don't depend on their order.
_UNIT = 1 << 24
#: What a block of a bucket holds: counted trigrams, counted bigrams, documents; from _ASKED on trigrams to look up in model 0, 1, 2.
_TRIGRAMS, _BIGRAMS, _DOCUMENTS, _ASKED = 0, 1, 2, 3
_BLOCK = "bucket int, kind int, data binary"
#: What a byte shows of its word's shape: capitals, lower case, digits, marks.
_KIND = np.full(256, 8, np.uint8)
_KIND[65:91] = 1
_KIND[97:123] = _KIND[128:] = 2
_KIND[48:58] = 4
_KIND[[0x20, *range(0x09, 0x0E), *b".,;:'\"()-"]] = 0


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Word hash, shape number, and word offsets of texts."""
    starts, ends, at = words(data, offsets)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64), at
    hashes = range_hash(prefix(_BYTE[data]), starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[at[:-1][at[1:] > at[:-1]]] = False  # no text goes on from another
    hashes[again] = _AGAIN  # a word said twice running
    # white space has no kind, so bytes up to the next word's start add nothing
    kinds = _KIND[data]
    kinds |= (kinds & 1) << 4  # a capital that isn't the first byte
    kinds[starts] &= 15
    shape = np.bitwise_or.reduceat(kinds, starts).astype(np.int64)
    # capitals only at the start are not a mixture
    shape = np.where(shape & 19 == 3, shape & ~1, shape) & 15
    return hashes, shape, at


def _ids(hashes: np.ndarray, shapes: np.ndarray, vocabulary: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Number of each word: that of its place in the sorted vocabulary, or after those _AGAIN's, the start's and the shapes'."""
    n = len(vocabulary)
    out = np.where(hashes == _AGAIN, n, n + 2 + shapes)
    if n:
        at = np.minimum(np.searchsorted(vocabulary, hashes), n - 1)
        out = np.where(vocabulary[at] == hashes, places[at], out)
    return out


def _packed(*arrays: np.ndarray) -> bytes:
    """pack() of the arrays' first bytes, second bytes and so on, which compresses better."""
    return pack(*(plane for x in arrays for plane in np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)))


def _unpacked(block: bytes, kinds) -> list[np.ndarray]:
    planes, out = iter(unpack(block)), []
    for kind in map(np.dtype, kinds):
        out.append(np.ascontiguousarray(np.stack([next(planes) for _ in range(kind.itemsize)], axis=1)).view(kind)[:, 0])
    return out


def _histories(ids: np.ndarray, at: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The last word but one and the last word before each; every text begins after two `start` words."""
    one, two = np.full(len(ids), start), np.full(len(ids), start)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    first = at[:-1][at[1:] > at[:-1]]
    one[first] = two[first] = start
    second = first + 1
    two[second[second < len(ids)]] = start
    return two, one


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _halves(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("half").to_numpy(zero_copy_only=False)


def _word_counts(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        half = _halves(batch)
        for i, j in slices(offsets):
            hashes, shapes, at = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            found, first, inverse, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            second = np.bincount(inverse, np.repeat(half[i:j], np.diff(at)), len(found)).astype(np.int64)
            shape = np.where(found == _AGAIN, -1, shapes[first]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([_signed(found), pa.array(shape), pa.array(count, pa.int64()), pa.array(second)], ["w", "shape", "n", "n1"])


@dataclass
class Deal:
    """Numbers of words, and the buckets that n-grams are dealt to."""

    vocabulary: np.ndarray  # sorted hashes
    places: np.ndarray  # numbers of its words, the most frequent first: small numbers pack well
    slices: np.ndarray  # by word number: buckets that share the contexts that end in it
    buckets: int

    def numbers(self, hashes: np.ndarray, shapes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Every word with the two before it."""
        ids = _ids(hashes, shapes, self.vocabulary, self.places)
        return [x.astype(np.int32) for x in (*_histories(ids, at, len(self.vocabulary) + 1), ids)]

    def bucket(self, word: np.ndarray, part: np.ndarray) -> np.ndarray:
        out = mix64((word.astype(U) << U(32)) | part.astype(U)) % U(self.buckets)
        return out.astype(np.uint16 if self.buckets <= 1 << 16 else np.int32)  # 16 bits are sorted faster

    def of_context(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return self.bucket(one, mix64(two.astype(U) + U(1)) % self.slices[one].astype(U))


def _blocks(kind: int, bucket: np.ndarray, packed) -> pa.RecordBatch:
    """One row for each bucket; packed(order, p, q) gives the data of places order[p:q]."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    data = [packed(order[p:q]) for p, q in pairwise([*first.tolist(), len(order)])]
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.full(len(found), kind, np.int32)), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


def _counted(two, one, word, n, n1) -> list[np.ndarray]:
    """Different trigrams in order, with the sums of their counts (of all, and of the second half)."""
    order = np.lexsort((word, one, two))
    two, one, word = two[order], one[order], word[order]
    new = np.ones(len(order), bool)
    new[1:] = (two[1:] != two[:-1]) | (one[1:] != one[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    total = lambda x: np.add.reduceat(x[order], first) if len(first) else x
    return [two[first], one[first], word[first], total(n), total(n1)]


def _trigram_blocks(held):
    def run(batches):
        deal = held.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            half = _halves(batch)
            for i, j in slices(offsets, 1 << 22):
                hashes, shapes, at = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                taught = hashes != _AGAIN  # repetition is never taught, so it stays improbable
                if not taught.any():
                    continue
                two, one, word = (x[taught] for x in deal.numbers(hashes, shapes, at))
                n1 = np.repeat(half[i:j], np.diff(at))[taught].astype(np.int64)
                found = _counted(two, one, word, np.ones(len(n1), np.int64), n1)
                yield _blocks(_TRIGRAMS, deal.of_context(found[0], found[1]), lambda places, found=found: _packed(*(x[places] for x in found)))

    return run


def _stacked(blocks: list[bytes], kinds) -> list[np.ndarray]:
    columns = list(zip(*(_unpacked(b, kinds) for b in blocks), strict=True))
    return [np.concatenate(c) for c in columns] if columns else [np.zeros(0, k) for k in kinds]


_TRIGRAM = (np.int32, np.int32, np.int32, np.int64, np.int64)
_BIGRAM = (np.int32, np.int32, np.int64, np.int64, np.int64)
_ABOUT = (np.int64,) * 4  # key, words, markers, good
_QUESTION = (np.int32, np.int32, np.int32, np.int64, np.int32)  # trigrams, keys, where each key's begin


def _merged(group: pa.Table) -> pa.Table:
    """The blocks of a bucket as one."""
    data = _packed(*_counted(*_stacked(group.column("data").to_pylist(), _TRIGRAM)))
    return pa.table({"bucket": group.column("bucket").slice(0, 1), "kind": pa.array([_TRIGRAMS], pa.int32()), "data": pa.array([data], pa.binary())})


def _by_model(n: np.ndarray, n1: np.ndarray) -> list[np.ndarray]:
    """Counts of trigrams under the model of all text, of its first half, of its second half."""
    return [n, n - n1, n1]


def _summed(one, word, *counts) -> list[np.ndarray]:
    """Different bigrams in order, with the sums of their counts."""
    order = np.argsort(_pair(one, word), kind="stable")
    one, word = one[order], word[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    return [one[first], word[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in counts)]


def _bigram_counts(held):
    """Different words before each bigram under every model, dealt by the bigram's first word."""

    def run(batches):
        deal = held.value
        for batch in batches:
            for block in batch.column("data").to_pylist():
                _, one, word, n, n1 = _unpacked(block, _TRIGRAM)
                if len(one):
                    found = _summed(one, word, *((x > 0).astype(np.int64) for x in _by_model(n, n1)))
                    yield _blocks(_BIGRAMS, deal.bucket(found[0], np.zeros(len(found[0]), np.int64)), lambda places, found=found: _packed(*(x[places] for x in found)))

    return run


def _merged_bigrams(group: pa.Table) -> pa.Table:
    data = _packed(*_summed(*_stacked(group.column("data").to_pylist(), _BIGRAM)))
    return pa.table({"bucket": group.column("bucket").slice(0, 1), "kind": pa.array([_BIGRAMS], pa.int32()), "data": pa.array([data], pa.binary())})


def _bigram_spectrum(batches):
    for batch in batches:
        for block in batch.column("data").to_pylist():
            yield from _spectrum(_unpacked(block, _BIGRAM)[2:])


def _bigrams_by_word(discounts: list[np.ndarray]):
    """For every model m: bigrams that end in a word (n of m), their counts (t of m) and discounts (d of m) by the first word."""

    def run(batches):
        for batch in batches:
            for block in batch.column("data").to_pylist():
                one, word, *counts = _unpacked(block, _BIGRAM)
                if not len(one):
                    continue
                found, inverse = np.unique(np.concatenate([one, word]), return_inverse=True)
                first, last = inverse[: len(one)], inverse[len(one) :]
                columns = [pa.array(found)]
                for n, d in zip(counts, discounts):  # as many models as there are discounts
                    columns.append(pa.array(np.bincount(last, n > 0, len(found)).astype(np.int64)))
                    columns.append(pa.array(np.bincount(first, n, len(found)).astype(np.int64)))
                    columns.append(pa.array(np.bincount(first, np.where(n > 0, d[np.clip(n, 1, 3) - 1], 0.0), len(found))))
                table = pa.RecordBatch.from_arrays(columns, ["w", *(f"{c}{m}" for m in range(len(discounts)) for c in "ntd")])
                yield from (table.slice(i, 1 << 16) for i in range(0, len(found), 1 << 16))

    return run


def _spectrum(counts: list[np.ndarray]):
    """How many n-grams have each count from 1 to 4, under every model."""
    for m, x in enumerate(counts):
        found = np.bincount(np.minimum(x, 5), minlength=6)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(4, m, np.int32)), pa.array(np.arange(1, 5, dtype=np.int32)), pa.array(found[1:5])], ["m", "c", "n"])


def _trigram_spectrum(batches):
    for batch in batches:
        for block in batch.column("data").to_pylist():
            yield from _spectrum(_by_model(*_unpacked(block, _TRIGRAM)[3:]))


def _bigram_blocks(held):
    """Bigrams for every slice of their first word."""

    def run(batches):
        deal = held.value
        for batch in batches:
            for block in batch.column("data").to_pylist():
                columns = _unpacked(block, _BIGRAM)
                shares = deal.slices[columns[0]].astype(np.int64)
                at, part = np.repeat(np.arange(len(shares)), shares), spread(np.zeros(len(shares), np.int64), shares)
                if len(at):
                    yield _blocks(_BIGRAMS, deal.bucket(columns[0][at], part), lambda places, at=at, columns=columns: _packed(*(x[at[places]] for x in columns)))

    return run


def _discounts(found: dict[int, int]) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from the counts of counts."""
    n1, n2, n3, n4 = (found.get(i) or 0 for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return np.full(3, 0.5)
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return np.array([min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)])


@dataclass
class Level:
    """What every bucket needs of a model: discounts, and arrays by word number."""

    discounts3: np.ndarray
    discounts2: np.ndarray
    total2: np.ndarray  # of the bigrams' counts by their first word
    gamma2: np.ndarray  # back-off weight by first word
    p1: np.ndarray


@dataclass
class Model:
    """Blocks of counted n-grams by bucket, and what is broadcast."""

    grams: DataFrame
    deal: Deal
    levels: list[Level]  # of all text and, if it has halves, of the first and of the second


def train(sample: DataFrame, min_count: int = 3, buckets: int | None = None) -> Model:
    """The model of all texts of `sample` and, if it has a column `half` (0 or 1), the models of its halves under the same word numbers.

    A word has a number of its own if every half has it `min_count` times.  Only tables by word reach the driver.
    """
    spark = sample.sparkSession
    halves = "half" in sample.columns
    texts = sample.select("text", F.col("half").cast("int") if halves else F.lit(0).alias("half"))
    buckets = buckets or shuffle_partitions(spark)
    with freeing(spark):
        counted = texts.mapInArrow(_word_counts, "w long, shape int, n long, n1 long").groupBy("w", "shape").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
        known = (F.col("shape") >= 0) & ((F.least(F.col("n") - F.col("n1"), F.col("n1")) if halves else F.col("n")) >= min_count)
        counted = counted.groupBy(F.when(known, F.col("w")).alias("w"), F.when(~known, F.col("shape")).alias("shape")).agg(F.sum("n").alias("n")).toArrow()  # the other words by shape
        own = counted.column("w").is_valid()
        others, found = {r["shape"]: r["n"] for r in counted.filter(pc.invert(own)).to_pylist()}, counted.filter(own)
        hashes = found.column("w").to_numpy().view(U)
        said = found.column("n").to_numpy()
        ranked = np.lexsort((hashes, -said))
        hashes, said = hashes[ranked], said[ranked]
        places = np.argsort(hashes).astype(np.int32)
        vocabulary = hashes[places]
        share = np.concatenate([said, [others.get(i, 0) for i in (-1, None, *range(_SHAPES))]]) / max(1, said.sum() + sum(others.values()))
        share[len(vocabulary) :] = np.maximum(share[len(vocabulary) :], 0.01)  # marks and shapes may be more frequent elsewhere
        deal = Deal(vocabulary, places, np.maximum(1, np.ceil(buckets * share / 2)).astype(np.int32), buckets)
        held = spark.sparkContext.broadcast(deal)
        raw = texts.mapInArrow(_trigram_blocks(held), _BLOCK)
    trigrams = durable(raw.groupBy("bucket").applyInArrow(_merged, _BLOCK))
    bigrams = durable(trigrams.mapInArrow(_bigram_counts(held), _BLOCK).groupBy("bucket").applyInArrow(_merged_bigrams, _BLOCK))
    models = range(3 if halves else 1)
    with freeing(spark):
        spectrum = lambda blocks, of: {(r["m"], r["c"]): r["n"] for r in blocks.mapInArrow(of, "m int, c int, n long").groupBy("m", "c").agg(F.sum("n").alias("n")).collect()}
        spectrum3, spectrum2 = spectrum(trigrams, _trigram_spectrum), spectrum(bigrams, _bigram_spectrum)
        discounts3, discounts2 = ([_discounts({c: x.get((m, c)) for c in range(1, 5)}) for m in models] for x in (spectrum3, spectrum2))
        columns = [f"{c}{m}" for m in models for c in "ntd"]
        by_word = bigrams.mapInArrow(_bigrams_by_word(discounts2), "w int, " + ", ".join(f"{c} {'double' if c[0] == 'd' else 'long'}" for c in columns))
        by_word = by_word.groupBy("w").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    size = len(vocabulary) + 2 + _SHAPES

    def dense(value: str) -> np.ndarray:
        out = np.zeros(size)
        out[by_word.column("w").to_numpy()] = by_word.column(value).to_numpy()
        return out

    levels = []
    for m in models:
        n = dense(f"n{m}").astype(np.int64)
        d = _discounts(dict(enumerate(np.bincount(np.minimum(n, 5), minlength=6).tolist())))
        taken, total = np.where(n > 0, d[np.clip(n, 1, 3) - 1], 0.0), n.sum()
        p1 = (n - taken + taken.sum() / size) / total if total else np.full(size, 1 / size)
        total2 = dense(f"t{m}")
        gamma2 = np.where(total2 > 0, dense(f"d{m}") / np.maximum(total2, 1), 1.0)
        levels.append(Level(discounts3[m], discounts2[m], total2, gamma2.astype(np.float32), p1.astype(np.float32)))
    pa.default_memory_pool().release_unused()
    return Model(trigrams.unionByName(bigrams.mapInArrow(_bigram_blocks(held), _BLOCK)), deal, levels)


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b


class Bucket:
    """The counted n-grams of a bucket under one model."""

    def __init__(self, level: Level, trigrams: list[np.ndarray], bigrams: list[np.ndarray], m: int):
        self.level = level
        two, one, word, n, n1 = trigrams
        n = _by_model(n, n1)[m]
        here = n > 0
        context, n = _pair(two[here], one[here]), n[here]
        new = np.ones(len(n), bool)
        new[1:] = context[1:] != context[:-1]
        number = np.cumsum(new) - 1
        lost = level.discounts3[np.minimum(n, 3) - 1]
        total = np.bincount(number, n)
        self.contexts, self.gamma3 = context[new], np.append(np.bincount(number, lost) / total, 1.0)
        self.trigrams, self.own3 = _pair(number, word[here]), np.append((n - lost) / total[number], 0.0)
        one, word, *counts = bigrams
        here = counts[m] > 0
        n, one = counts[m][here], one[here]
        self.bigrams = _pair(one, word[here])
        self.own2 = np.append((n - level.discounts2[np.minimum(n, 3) - 1]) / level.total2[one], 0.0)

    def log_probabilities(self, two: np.ndarray, one: np.ndarray, word: np.ndarray) -> np.ndarray:
        at, found = _find(self.bigrams, _pair(one, word))
        p = self.own2[np.where(found, at, -1)] + self.level.gamma2[one].astype(np.float64) * self.level.p1[word]
        context, found = _find(self.contexts, _pair(two, one))
        at, taught = _find(self.trigrams, _pair(context, word))
        p = self.own3[np.where(found & taught, at, -1)] + self.gamma3[np.where(found, context, -1)] * p
        return np.log(np.maximum(p, 1e-12))


def _bigrams_in_order(blocks: list[bytes]) -> list[np.ndarray]:
    columns = _stacked(blocks, _BIGRAM)
    order = np.argsort(_pair(columns[0], columns[1]), kind="stable")
    return [c[order] for c in columns]


class Scorer:
    """A small model as one bucket on the driver."""

    def __init__(self, model: Model, m: int = 0):
        self.deal, rows = model.deal, model.grams.collect()
        trigrams = _counted(*_stacked([r["data"] for r in rows if r["kind"] == _TRIGRAMS], _TRIGRAM))
        self.bucket = Bucket(model.levels[m], trigrams, _bigrams_in_order([r["data"] for r in rows if r["kind"] == _BIGRAMS]), m)

    def log_probabilities(self, hashes: np.ndarray, shapes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.bucket.log_probabilities(*self.deal.numbers(hashes, shapes, at))


def _ask(held, markers):
    """Documents (key, model, good, text) as blocks for the buckets, named by their first key: their numbers of words and markers, and their trigrams, a document's together."""

    def run(batches):
        deal, bad = held.value, markers.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys, model, good = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "model", "good"))
            for i, j in slices(offsets, 1 << 22):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                hashes, shapes, at = _tokens(part, own)
                hits = np.zeros(j - i, np.int64)
                if len(bad) and len(hashes):
                    terms, places = term_hashes(part, own)
                    found = np.concatenate([[0], np.cumsum(bad[np.minimum(np.searchsorted(bad, terms), len(bad) - 1)] == terms)])
                    hits = found[places[1:]] - found[places[:-1]]
                about = _packed(keys[i:j].astype(np.int64), np.diff(at).astype(np.int64), hits.astype(np.int64), good[i:j].astype(np.int64))
                where = int(mix64(keys[i : i + 1].view(U))[0] % U(deal.buckets))
                yield pa.RecordBatch.from_arrays([pa.array([where], pa.int32()), pa.array([_DOCUMENTS], pa.int32()), pa.array([about], pa.binary()), pa.array(keys[i : i + 1])], ["bucket", "kind", "data", "block"])
                if not len(hashes):
                    continue
                grams = deal.numbers(hashes, shapes, at)
                doc = np.repeat(np.arange(i, j), np.diff(at))

                def packed(places, doc, grams):
                    mine = doc[places]
                    first = np.flatnonzero(np.diff(mine, prepend=-1))
                    return _packed(*(x[places] for x in grams), keys[mine[first]].astype(np.int64), first.astype(np.int32))

                for m in np.unique(model[i:j]).tolist():
                    chosen = [x[model[doc] == m] for x in (doc, *grams)]
                    if len(chosen[0]):
                        out = _blocks(_ASKED + m, deal.of_context(chosen[1], chosen[2]), lambda places, c=chosen: packed(places, c[0], c[1:]))
                        yield out.append_column("block", pa.array(np.full(out.num_rows, keys[i])))

    return run


_REPLY = "block long, kind int, data binary"
_SUMS = (np.int64, np.int64)
_SCORE = "key long, log_p long, n_words long, n_markers long, good long, n long"


def _reply(levels):
    """What a bucket adds to the documents of each block that asked."""

    def run(group: pa.Table) -> pa.Table:
        of: dict[int, list] = {}
        for kind, block, data in zip(*(group.column(c).to_pylist() for c in ("kind", "block", "data")), strict=True):
            of.setdefault(kind, []).append((block, data))
        held = lambda kind: [data for _, data in of.get(kind, [])]
        trigrams, bigrams = _stacked(held(_TRIGRAMS), _TRIGRAM), _bigrams_in_order(held(_BIGRAMS))
        rows = [(block, _DOCUMENTS, data) for block, data in of.get(_DOCUMENTS, [])]
        for m, level in enumerate(levels.value):
            if _ASKED + m in of:
                bucket = Bucket(level, trigrams, bigrams, m)
                for block, data in of[_ASKED + m]:
                    two, one, word, keys, first = _unpacked(data, _QUESTION)
                    sums = np.add.reduceat(np.rint(bucket.log_probabilities(two, one, word) * _UNIT).astype(np.int64), first)
                    rows.append((block, _ASKED, _packed(keys, sums)))
        columns = zip(*rows) if rows else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], names=["block", "kind", "data"])

    return run


def _added(group: pa.Table) -> pa.Table:
    """The documents of a block with the sums of all buckets."""
    kinds, data = group.column("kind").to_pylist(), group.column("data").to_pylist()
    keys, *about = _stacked([d for k, d in zip(kinds, data) if k == _DOCUMENTS], _ABOUT)
    found, first, n = np.unique(keys, return_index=True, return_counts=True)
    log_p = np.zeros(len(found), np.int64)
    for k, d in zip(kinds, data):
        if k != _DOCUMENTS:
            asked, sums = _unpacked(d, _SUMS)
            np.add.at(log_p, np.searchsorted(found, asked), sums)
    words, hits, good = (x[first] for x in about)
    return pa.table([pa.array(x) for x in (found, log_p, words * n, hits * n, good, n)], names=[f.split()[0] for f in _SCORE.split(", ")])


def score(docs: DataFrame, model: Model, markers: np.ndarray, rounds: int = 4) -> DataFrame:
    """(key, n_words, log_p, n_markers, good) of all `docs` (key, model, good, text); rows of one key are one text.

    Words travel to their contexts' buckets, so documents go in `rounds`, which bounds the disk by that part of the corpus.
    """
    context = docs.sparkSession.sparkContext
    held, bad, levels = (context.broadcast(x) for x in (model.deal, markers, model.levels))
    out = None
    for i in range(rounds):
        asked = docs.where(F.pmod("key", F.lit(rounds)) == i).mapInArrow(_ask(held, bad), f"{_BLOCK}, block long")
        grams = model.grams.withColumn("block", F.lit(None).cast("long"))
        replies = grams.unionByName(asked).groupBy("bucket").applyInArrow(_reply(levels), _REPLY)
        sums = replies.groupBy("block").applyInArrow(_added, _SCORE).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("log_p", "n_words", "n_markers", "n")), F.max("good").alias("good"))
        found = durable(sums.select("key", *(F.expr(f"{c} div n").alias(c) for c in ("n_words", "n_markers")), (F.expr("log_p div n") / _UNIT).alias("log_p"), "good"))
        out = found if out is None else out.unionByName(found)
    return out


def _terms(batches):
    """Documents that have each term, toxic and others."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for i, j in slices(offsets):
            terms, at = term_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            doc = np.repeat(np.arange(i, j), np.diff(at))
            order = np.lexsort((terms, doc))
            doc, terms = doc[order], terms[order]
            new = np.ones(len(order), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (terms[1:] != terms[:-1])
            found, inverse, n = np.unique(terms[new], return_inverse=True, return_counts=True)
            hit = np.bincount(inverse, toxic[doc[new]], len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_signed(found), pa.array(hit), pa.array(n.astype(np.int64) - hit)], ["t", "bad", "good"])


def find_markers(labelled: DataFrame, share: float = 0.02, least: int = 5, ratio: float = 100.0) -> np.ndarray:
    """Terms in at least `share` of the toxic documents (and `least`) and `ratio` times as common there as in others.  Copies count once."""
    once = lambda by: labelled.groupBy(by).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in once(F.xxhash64("text").alias("h")).groupBy("toxic").count().collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return np.zeros(0, U)
    terms = once("text").mapInArrow(_terms, "t long, bad long, good long").groupBy("t").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    terms = terms.where((F.col("bad") >= max(least, share * n_bad)) & (F.col("bad") / n_bad >= ratio * F.col("good") / n_good))
    return np.sort(terms.select("t").toArrow().column(0).to_numpy().view(U))


def _quantiles(rows: DataFrame, shares: tuple[float, ...], accuracy: int = 100_000) -> dict:
    """Exact quantiles of column p by language, and under ... of all languages.

    An approximate pass brackets each; rows below the bracket are counted and only those inside it are sorted.
    """
    every = rows.select("lang", F.lit(False).alias("all"), "p").unionByName(rows.select(F.lit(None).cast(rows.schema["lang"].dataType).alias("lang"), F.lit(True).alias("all"), "p"))
    near = [min(max(q + d, 0.0), 1.0) for q in shares for d in (-4 / accuracy, 4 / accuracy)]
    ends = [(r["lang"], r["all"], r["n"], r["e"]) for r in every.groupBy("lang", "all").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("p", F.array(*map(F.lit, near)), accuracy).alias("e")).collect()]
    out: dict = {}
    for lang, all_, n, e in ends:
        mine = rows if all_ else rows.where(F.col("lang").eqNullSafe(F.lit(lang)))
        for i, q in enumerate(shares):
            inside = F.col("p").between(e[2 * i], e[2 * i + 1])
            below = mine.where(F.col("p") < e[2 * i]).count()
            place = max(1, int(np.ceil(q * n))) - below
            counts = mine.where(inside).groupBy("p").count().orderBy("p").collect()
            total = np.cumsum([r["count"] for r in counts])
            out.setdefault(... if all_ else lang, []).append(counts[int(np.searchsorted(total, place))]["p"])
    return out


def classify(
    docs: DataFrame,
    labels: DataFrame,
    max_train: int | None = None,
    low: float = 0.0,
    high: float = 0.999,
    slack: float = 1.25,
    prior: int = 30,
    min_markers: int = 1,
    max_broadcast: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """All columns of `docs`, then n_words, perplexity, lowest, highest, n_markers and keep.

    `labels` has (doc_id, quality, toxic).  All documents labelled good train the model and set the languages' quantiles, each
    judged by the half of them that it isn't in.  All documents labelled toxic, against all labelled otherwise (good or not), give
    the markers.  Rows are taught as often as they stand.  A caller may teach `max_train` documents only (those with the smallest
    hash of their id); the others labelled good are then judged by the whole model.
    Perplexities are drawn towards the language's mean by `prior` words, so a few odd words don't reject a short text; the
    quantiles `low` and `high` are widened by `slack` (0 for `low`: no lower bound; repetition is improbable by itself).

    Edges: texts without words have a null perplexity and are kept; a language without labelled text gets the bounds of all languages;
    null languages are a language of their own; with no trusted labels all is kept; a document labelled twice is good only if all
    its labels are good; repeated rows are scored alike; a long text is scored whole; input columns named like an output are replaced.
    """
    new = ("n_words", "perplexity", "lowest", "highest", "n_markers", "keep")
    spark = docs.sparkSession
    small_batches(spark, 2000)
    kept = [c for c in docs.columns if c.lower() not in new]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    toxic = F.coalesce("t", F.lit(0))
    known = known.withColumn("good", F.coalesce((F.col("q") == 1) & (toxic == 0), F.lit(False)).cast("int")).where("good = 1 or t in (0, 1)")
    known = known.select("_id", "good", toxic.alias("toxic"), F.col("good").alias("taught"))
    if max_train is not None:
        chosen = known.where("good = 1").orderBy(F.xxhash64(F.lit(5), "_id"), "_id").limit(max_train).select("_id", F.lit(1).alias("one"))
        known = known.join(chosen, "_id", "left").select("_id", "good", "toxic", F.coalesce("one", F.lit(0)).alias("taught"))
    if known.count() <= max_broadcast:  # ids only; else documents are shuffled
        known = F.broadcast(known)
    text = F.col(text_col).cast("string")
    key = F.xxhash64(F.col(id_col), text)
    own = docs.select(F.col(id_col).alias("_id"), text.alias("text"), key.alias("key"))
    labelled = own.join(known, "_id").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    model = train(labelled.where("taught = 1").select("text", "half"), buckets=_buckets(own))
    with freeing(spark):
        markers = find_markers(labelled.select("text", "toxic"))
    every = own.join(known, "_id", "left").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    other_half = F.when(F.col("taught") == 1, 2 - F.col("half")).otherwise(0)
    scores = score(every.select("key", other_half.alias("model"), F.coalesce("good", F.lit(0)).alias("good"), "text"), model, markers)

    trusted = scores.where("good = 1 and n_words > 0").select("key", "n_words", "log_p")
    check = durable(docs.select(F.col(lang_col).alias("lang"), key.alias("key")).join(trusted, "key").drop("key"))
    mean = F.sum("log_p") / F.sum("n_words")
    means = {r[0]: r[1] for r in check.groupBy("lang").agg(mean).collect()}
    everywhere = check.agg(mean).first()[0] or 0.0
    smooth = lambda centre: F.exp(-(F.col("log_p") + prior * centre) / (F.col("n_words") + prior))
    found = _quantiles(check.withColumn("p", smooth(_by_language(F.col("lang"), means, everywhere))), (low, high) if low > 0 else (high,))
    found = {k: (v[0] / slack if low > 0 else 0.0, v[-1] * slack) for k, v in found.items()}
    over = found.pop(..., (0.0, float("inf")))
    scores = scores.select(F.col("key").alias("_quality_key"), "n_words", "log_p", "n_markers")
    out = docs.select(*(F.col(f"`{c}`") for c in kept), key.alias("_quality_key")).join(scores, "_quality_key")
    lang = F.col(f"`{lang_col}`")
    out = out.withColumn("perplexity", F.when(F.col("n_words") > 0, smooth(_by_language(lang, means, everywhere))))
    for i, name in enumerate(("lowest", "highest")):
        out = out.withColumn(name, _by_language(lang, {k: v[i] for k, v in found.items()}, over[i]))
    keep = F.coalesce(F.col("perplexity").between(F.col("lowest"), F.col("highest")), F.lit(True)) & (F.col("n_markers") < min_markers)
    return out.select(*(F.col(f"`{c}`") for c in kept), "n_words", "perplexity", "lowest", "highest", "n_markers", keep.alias("keep"))


def _buckets(texts: DataFrame, size: int = 1 << 25) -> int:
    """One for every 32 MB of text, and at least one a shuffle partition."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_partitions(texts.sparkSession), total // size + 1)


def _by_language(lang, values: dict, otherwise: float):
    """A value per language: as many cases as the corpus has languages."""
    out = F.lit(float(otherwise))
    for k, v in values.items():
        out = F.when(lang.isNull() if k is None else lang == k, F.lit(float(v))).otherwise(out)
    return out
