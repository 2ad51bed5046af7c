"""Periodic runs, ranked search and neighbours, beside brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from binweave.llm import neighbours, periodic, queries, ranked

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def runs_of(w, least=12, exponent=2):
    """All lags, all places; the smallest period of a stretch comes first."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, own):
    gone = {i for s, n, q in own for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(rng):
    n, kinds = rng.choice([0, 1, 11, 12, 40, 130]), rng.choice([1, 2, 4, 40])
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if n > 20 and rng.random() < 0.7:
        a, p = rng.randrange(n), rng.randint(1, n // 3)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_at_all_lags():
    rng = random.Random(3)
    for _ in range(300):
        texts = [random_words(rng) for _ in range(rng.randint(1, 4))]
        names = {}
        w = np.array([names.setdefault(x, len(names)) for t in texts for x in t], np.int64)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        least, exponent = rng.choice([(12, 2), (5, 2), (12, 3)])
        assert periodic.runs(w, at, least, exponent) == [runs_of(t, least, exponent) for t in texts]


def test_runs_of_documents(spark):
    rng = random.Random(4)
    texts = [" ".join(random_words(rng)) for _ in range(40)] + [None, "", "  \t ", " ".join(["ñ a", "b"] * 400), " ".join(["same"] * 3000)]
    rows = [(k if k % 7 else None, t, k) for k, t in enumerate(texts)] + [(1, texts[1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    whole = periodic.find_runs(docs)
    assert whole.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    dealt = periodic.find_runs(docs, long=100, factor=2)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, dealt.collect())) and whole.count() == len(rows)
    for r in whole.collect():
        w = WORD.findall(r["text"] or "")
        own = runs_of(w) if len(w) < 2000 else [(0, len(w), 1)]
        assert [tuple(x) for x in r["runs"]] == own and r["n_words"] == len(w) and r["collapsed"] == collapsed(w, own)
    assert periodic.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, exponent=1)


def test_registered_runs(spark):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, FOLDER).collect()}
    planted = 0
    for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        w = WORD.findall(d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        names = {}
        own = periodic.runs(np.array([names.setdefault(x, len(names)) for x in w], np.int64), np.array([0, n]))[0] if n > 900 else runs_of(w)
        best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(own), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if own else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in own).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, own).encode()).hexdigest()
    assert planted > 5


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked_by_hand(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs if i is not None and terms_of(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_product_with_edges(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choice(["Alpha", "beta!", "ÀB", "gamma-3", "x", "y_z", "?"]) for _ in range(rng.randint(0, 30)))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, "-- ?"), (None, "alpha beta"), (7, docs[7][1]), (503, "alpha " * 5000)]
    items = [(1, "alpha ALPHA beta"), (2, "àb Àb y"), (3, ""), (4, None), (5, "unknown"), (6, "x y z x")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("clash"))
    q = spark.createDataFrame([*items, (None, "alpha")], "item_id long, text string").withColumn("score", F.lit(1))
    want = ranked_by_hand(docs, items, 4)
    assert sorted(map(tuple, ranked.rank(d, q, k=4).collect())) == want
    monkeypatch.setattr(ranked, "ITEM_TERMS", 2)  # several blocks of items
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, ranked.rank(d, q, k=4).collect())) == want
    assert ranked.rank(d.limit(0), q).count() == 0 and ranked.rank(d, q.limit(0)).count() == 0


def test_registered_ranking(spark):
    from tests.compare import database, difference

    assert difference(spark, database(FOLDER), FOLDER, queries.op12_sparse_product_search, queries.oracle_sql()["op12_sparse_product_search"]) is None


def true_nearest(rows, query, k):
    ok = [(i, np.array(v, float)) for i, v in rows]
    q = next(v for i, v in ok if i == query)
    found = sorted((-float((v * q).sum() / (math.sqrt((v * v).sum()) * math.sqrt((q * q).sum()))), i) for i, v in ok if i != query)
    return [(i, -s) for s, i in found[:k]]


def test_forest_with_edges(spark):
    rng = np.random.default_rng(6)
    good = [(i, rng.normal(size=20).astype(np.float32).tolist()) for i in range(300)]
    hot = rng.normal(size=20).astype(np.float32).tolist()
    good += [(1000 + i, hot) for i in range(200)] + [(2000, [x * 2 for x in hot]), (2001, [1e30] * 20)]
    bad = [(3000, None), (3001, []), (3002, [0.0] * 20), (3003, [float("nan")] * 20), (3004, [None] * 20), (3005, [float("inf")] + [1.0] * 19), (None, hot)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    asked = df.where("vec_id % 50 = 0 or vec_id > 2999")
    got = {}
    for r in neighbours.nearest(df, asked, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids = [i for i, _ in good if i % 50 == 0]
    assert sorted(got) == sorted(ids)
    for i in ids:
        want = true_nearest(good, i, 5)
        assert [x for x, _ in got[i]] == [x for x, _ in want]  # so few rows are all met
        assert all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got[i], want))
    few = df.where("vec_id < 3")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 2
    assert neighbours.nearest(df.limit(0), asked).count() == 0 and neighbours.nearest(df, df.limit(0)).count() == 0 and neighbours.nearest(df.where("vec_id >= 3000"), df).count() == 0


def test_prefixes_ascend_together():
    keys = np.sort(np.array([[0b0000, 0b0001, 0b0110, 0b1100, 0b1111], [0b0011, 0b0100, 0b1000, 0b1001, 0b1010]], np.uint64), axis=1)
    wanted = np.array([[0b0001], [0b1001]], np.uint64)
    full = neighbours.met(keys, wanted, length=2, bits=2, enough=1)[0]
    assert full == [(0, 1, 2)]  # the first tree alone holds enough at the longest prefix
    up = neighbours.met(keys, wanted, length=2, bits=2, enough=4)[0]
    assert up == [(0, 0, 2), (1, 2, 5)]
    assert neighbours.met(keys, wanted, length=2, bits=2, enough=99)[0] == [(0, 0, 5), (1, 0, 5)]


def test_recall_on_vectors_without_structure(spark):
    """Random directions are the hardest case; few of 6,000 rows are met by default here, and 9 of 10 neighbours found."""
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(6000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<float>")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0"), k=5, least=500).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in got:
        s = unit @ unit[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 120 and hits >= 0.9 * 600


def test_parts_of_a_benchmark_change_nothing(spark):
    """Items are weighed by all of them, however many passes they take."""
    from binweave.llm.decontamination import find_leaks

    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 60)))) for i in range(80)]
    docs = []
    for k in range(60):
        own = items[rng.randrange(80)][1].split()
        own = [w if rng.random() > 0.25 else rng.choice(vocabulary) for w in own]
        docs.append((k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 200)) + own + rng.choices(vocabulary, k=30))))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    least = (0.0, 0.0, 0.0)
    one, several = (sorted(map(repr, find_leaks(d, q, threshold=0.4, least=least, max_items=m).collect())) for m in (1000, 13))
    assert one == several and sum("contaminated=True" in r for r in one) > 20


def test_long_runs_of_digits(spark):
    import time

    from binweave.llm.pii import base_spans

    began = time.time()
    assert base_spans("1" * 1_000_000) == [] and time.time() - began < 10
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice("12.05 a") for _ in range(rng.randint(0, 40)))
        want = [("ip", m.start(), m.end()) for m in plain.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        assert [s for s in base_spans(text) if s[0] == "ip"] == want


def tree_by_hand(rows, leaves):
    """(node, dim, cut) of every split: keys sorted, weights added up."""
    out, spans = [], None
    todo = [(1, leaves, rows)]
    while todo:
        node, m, own = todo.pop(0)
        if m < 2 or not own:
            continue
        widths = [(max(r[1 + d] >> 36 for r in own) - min(r[1 + d] >> 36 for r in own)) for d in range(len(own[0]) - 1)]
        spans = spans or [max(1, w) for w in widths]
        dim = max(range(len(widths)), key=lambda d: (widths[d] / spans[d], -d))
        goal, upto, cut = sum(r[0] for r in own) * (m // 2) / m, 0, None
        for key in sorted({r[1 + dim] for r in own}):
            here = sum(r[0] for r in own if r[1 + dim] == key)
            if upto + here >= goal:
                cut = key + (upto + here - goal <= goal - upto)
                break
            upto += here
        out.append((node, dim, cut))
        todo += [(2 * node, m // 2, [r for r in own if r[1 + dim] < cut]), (2 * node + 1, m - m // 2, [r for r in own if r[1 + dim] >= cut])]
    return sorted(out)


def test_medians_by_hand(spark):
    """Exact weighted medians along the dimension that is widest for its whole span."""
    from binweave.llm.sharding import kd_tree

    rng = random.Random(10)
    for leaves, kinds in ((8, 1 << 62), (5, 40), (6, 3)):
        low = [rng.randrange(1 << 62) for _ in range(kinds)] if kinds < 100 else None
        draw = lambda: rng.choice(low) if low else rng.randrange(1 << 62)
        rows = [(rng.choice([1, 5, 400]), draw(), (draw() >> 3) if rng.random() < 0.8 else draw()) for _ in range(700)]
        df = spark.createDataFrame(rows, "w long, k0 long, k1 long").repartition(3)
        got = sorted((s.node, s.dim, s.cut) for s in kd_tree(df, "w", ["k0", "k1"], leaves))
        assert got == tree_by_hand(rows, leaves)
