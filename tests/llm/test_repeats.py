"""Repeated bytes and word windows against brute force."""

import random

from pyspark.sql import functions as F

from binweave.llm._windows import Windows
from binweave.llm.rlz_dedup import drop_repeated_words, parse
from binweave.llm.suffix_dedup import drop_repeated_bytes, multikey_quicksort

LAST = 1 << 63


def brute(rows, length, split):
    """Kept symbols and number removed for each row, by comparing all windows."""
    least = {}
    seqs = [(LAST if i is None else i, split(t or "")) for i, t in rows]
    for key, s in seqs:
        for a in range(len(s) - length + 1):
            w = tuple(s[a : a + length])
            least[w] = min(least.get(w, LAST), key)
    out = []
    for key, s in seqs:
        gone = [False] * len(s)
        for a in range(len(s) - length + 1):
            if least[tuple(s[a : a + length])] < key:
                gone[a : a + length] = [True] * length
        out.append(([x for x, g in zip(s, gone) if not g], sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone]))))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "a", "Straße", "näher", *("".join(r.choices("abcdeéñ", k=r.randint(2, 9))) for _ in range(60))]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\n", ". ", "  "]) for _ in range(n))
    base = [text(r.randint(1, 150)) for _ in range(25)]
    passage = text(40)
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(25, 60):
        t = r.choice(base)
        cut = r.randint(0, len(t))
        rows.append((i, r.choice([t, t[:cut] + "X" + t[cut:], text(30) + t[cut:], text(5) + passage + text(9), passage[3:-5], "", "x" * 49, "y" * 120])))
    rows += [(60, "y" * 119 + "é"), (7, base[3]), (None, base[2]), (None, base[2]), (61, None), (62, "x" * 49), (63, "le " * 400), (64, "le " * 30), (64, "le " * 30)]
    r.shuffle(rows)
    return rows


def check(result, rows, expected, size):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["kept"]) if not isinstance(r["kept"], str) else r["kept"].encode(), r[size], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"])) for r in result))
    want = sorted((i is None, i or 0, kept, n, gone, runs) for (i, _), (kept, n, gone, runs) in zip(rows, expected))
    assert got == want


def test_bytes(spark):
    for seed, hot in ((1, 50_000), (2, 50_000), (1, 1), (2, 3)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).repartition(3)
        want = [(bytes(k), len((t or "").encode()), gone, runs) for (_, t), (k, gone, runs) in zip(rows, brute(rows, 50, lambda t: t.encode()))]
        check(drop_repeated_bytes(docs, hot=hot).collect(), rows, want, "n_bytes")


def test_words(spark):
    for seed, hot in ((3, 50_000), (4, 50_000), (3, 1), (4, 3)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("grp", F.lit(1)).repartition(3)
        want = [(b" ".join(k), len((t or "").encode().split()), gone, runs) for (_, t), (k, gone, runs) in zip(rows, brute(rows, 13, lambda t: t.encode().split()))]
        check(drop_repeated_words(docs, hot=hot).collect(), rows, want, "n_words")


def phrases(words):
    """One phrase in every document, its neighbourhood different each time but for every fourth."""
    r = random.Random(5)
    other = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    phrase = other(words)
    return [(i, f"{'some words that come again and again' if i % 4 == 0 else other(7)} {phrase} {other(9)}") for i in range(600)]


def test_a_phrase_with_many_neighbourhoods(spark):
    """Split or not, a hot phrase gives what brute force gives."""
    for words, drop, length, split, size in ((9, drop_repeated_words, 13, lambda t: t.encode().split(), "n_words"), (16, drop_repeated_words, 13, lambda t: t.encode().split(), "n_words"), (6, drop_repeated_bytes, 50, lambda t: t.encode(), "n_bytes")):
        rows = phrases(words)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        join = b" ".join if size == "n_words" else bytes
        want = [(join(k), len(split(t)), gone, runs) for (_, t), (k, gone, runs) in zip(rows, brute(rows, length, split))]
        for hot in (100, 50_000):
            check(drop(docs, hot=hot).collect(), rows, want, size)


def test_parse():
    """Factors are as long as their source goes on, and a change inside a stretch starts a new one."""
    import numpy as np

    spec = Windows(4, 2, True)
    texts = np.arange(30, 36)[None, :].repeat(3, 0).astype(np.uint64)
    texts[2, 5] = 99
    row, first, windows = parse(spec, texts, np.ones((3, 6), bool), np.array([1, 2, 3]), np.array([2, 2, 2]), np.array([3, 3, 3]))
    assert sorted(zip(row.tolist(), first.tolist(), windows.tolist())) == [(1, 0, 3), (2, 0, 2)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_bytes(none).count() == 0
    assert drop_repeated_words(none).count() == 0


def test_multikey_quicksort():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 3, (5000, 6)).astype(np.uint64)
    order = multikey_quicksort(keys)
    assert sorted(order) == list(range(5000))
    assert (keys[order] == np.array(sorted(map(tuple, keys)))).all()


def test_colliding_hashes_are_told_apart(monkeypatch):
    """With two bits of hash left, bytes alone decide which windows are equal."""
    import numpy as np

    from binweave.llm import suffix_dedup

    rng = np.random.default_rng(4)
    spec = Windows(6, 2, False)
    matrix = rng.integers(0, 2, (400, spec.width)).astype(np.uint8)
    key, off, count = rng.integers(0, 90, 400), np.full(400, 3), np.ones(400, np.int64)
    start = spec.left - 3
    least = {}
    for r in range(400):
        w = matrix[r, start : start + 6].tobytes()
        least[w] = min(least.get(w, 99), key[r])
    want = {r for r in range(400) if least[matrix[r, start : start + 6].tobytes()] < key[r]}
    for bits in (2, 64):
        monkeypatch.setattr(suffix_dedup, "mix64", lambda x: x & np.uint64((1 << bits) - 1))
        rows, at = suffix_dedup.shared_windows(spec, matrix, np.ones_like(matrix, bool), key, off, count)
        assert set(rows.tolist()) == want and len(rows) == len(want) and set(at.tolist()) == {0}
