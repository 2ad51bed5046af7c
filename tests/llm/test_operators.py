"""The other operators against brute force, round trips and held-out labels."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from binweave.llm import decontamination, mixing, packing, pii, quality, search, sharding
from binweave.llm._text import unpack

TYPES = "doc_id long, text string, lang string, source string"


def documents(seed=1, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "The", "of"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(int(r.paretovariate(1.0) * 5) % 900)), r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    rows += [(n, "", "en", "a"), (n + 1, None, "en", "b"), (None, "without id", "en", "d"), rows[3], rows[3], (n + 2, "x " * 3000, "de", "c")]
    return rows


def test_shards_are_even_and_gapless(spark):
    rows = documents(n=900)
    docs = spark.createDataFrame(rows, TYPES).withColumn("Size", F.lit("clash"))
    out = sharding.shard(docs, shards=8).collect()
    assert len(out) == len(rows)
    sums, slots = defaultdict(int), defaultdict(list)
    for r in out:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(sums) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest = max(r["size"] for r in out)
    assert max(sums.values()) - min(sums.values()) <= 2 * biggest
    again = sharding.shard(docs.repartition(5), shards=8).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["shard"]) for r in again) == sorted((r["doc_id"] is None, r["doc_id"], r["shard"]) for r in out)
    assert sharding.shard(docs.limit(0), shards=8).count() == 0
    assert {r["shard"] for r in sharding.shard(docs, target_bytes=60_000).collect()} == set(range(-(-sum(sums.values()) // 60_000)))


def test_one_text_for_most_rows_is_split(spark):
    docs = spark.createDataFrame([(i, "the same words") for i in range(800)], "doc_id long, text string")
    counts = [r["count"] for r in sharding.shard(docs, shards=8).groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 4


def test_equal_texts_share_a_shard_where_sizes_allow(spark):
    r = random.Random(9)
    rows = [(i, f"text {i // 4} " + "x" * (i // 4 % 50), r.choice(["en", "en", "de"])) for i in range(4000)]
    rows = [(i, t, rows[i // 4 * 4][2]) for i, t, _ in rows]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string"), shards=8, slack=0.01).collect()
    of, sums = defaultdict(set), Counter()
    for x in out:
        of[x["text"]].add(x["shard"])
        sums[x["shard"]] += x["size"]
    assert all(len(s) == 1 for s in of.values())
    assert max(sums.values()) - min(sums.values()) <= 0.06 * sum(sums.values()) / 8


CLASHES = ("row", "id", "size", "src", "key", "of", "before", "_bucket", "_group", "_at", "_base", "_local", "node", "_node", "k0", "c0", "epochs")


def test_no_column_of_the_input_is_lost(spark):
    docs = spark.createDataFrame(documents(n=50), TYPES)
    for i, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.lit(i))
    for out in (mixing.mix(docs), sharding.shard(docs, shards=3)):
        for r in out.collect():
            assert all(r[name] == i for i, name in enumerate(CLASHES) if name != "size") and r["size"] is not None
    assert mixing.mix(docs).columns == [*TYPES.replace(" long", "").replace(" string", "").split(", "), *(c for c in CLASHES if c != "size"), "size", "source_size", "target", "copies", "taken"]


def test_no_task_gets_most_of_a_source_of_low_weights(spark):
    """Keys of texts that are nearly all digits lie far out; the ranges that tasks get hold no large share of a source all the same."""
    u = [(i + 0.5) / 20_000 for i in range(20_000)]
    for weights in ([1.0], [1e-6], [0.1, 0.15], [1.0, 1e-6, 0.02]):
        bins = Counter(int(np.floor(np.log2(-np.log(x) / weights[i % len(weights)]) * 64)) for i, x in enumerate(u))
        assert max(bins.values()) < 0.006 * len(u)


def test_mix_takes_what_the_keys_order_says(spark):
    rows = documents(n=400) + [(i, "1234 " * (i % 9), "en", "digits") for i in range(1000, 1100)]
    docs = spark.createDataFrame(rows, TYPES)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", "text"), 12).cast("double") + 0.5) / float(1 << 52)
    out = mixing.mix(docs).withColumn("u", u).collect()
    for source in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == source]
        total, goal = own[0]["source_size"], own[0]["target"]
        epochs = int(goal // total)
        letters = lambda t: 1 - sum(not (c.isalpha() or c.isspace()) for c in t) / max(1, len(t))
        own.sort(key=lambda r: (-np.log(r["u"]) / max(1e-6, letters(r["text"] or "")), r["doc_id"] is None, r["doc_id"]))
        before, left, want = 0, goal - epochs * total, 0
        for r in own:
            want += r["size"] * (epochs + (before < left and 2 * before + r["size"] <= 2 * left))
            before += r["size"]
        assert abs(sum(r["taken"] for r in own) - want) <= 1e-9, source


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3], 3) == [50, 100, 150]
    assert mixing.targets([10, 1000], [3, 1], 3) == [30, 980]
    assert mixing.targets([0, 5], [1, 1], 3) == [0, 5]


def test_mix(spark):
    rows = documents(n=2000)
    docs = spark.createDataFrame(rows, TYPES).withColumn("target", F.lit(1))
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in out:
        assert r["size"] == size(r["text"]) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        total[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    names = sorted(total, key=lambda s: (s is None, s))
    want = mixing.targets([total[s] for s in names], mixing.rotating_weights(names), 3)
    for s, t in zip(names, want):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= largest[s] / 2 + 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"] is None, r["doc_id"], r["copies"]) for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_segment_tree_is_best_fit():
    r = random.Random(2)
    lengths = [r.randint(1, 50) for _ in range(500)]
    bins = packing.best_fit_decreasing(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(lengths[i] for i in b) <= 50 for b in bins)
    rooms: list[int] = []  # plain best fit decreasing gives as many bins
    for x in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(rooms) if room >= x]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= x
        else:
            rooms.append(50 - x)
    assert len(bins) == len(rooms)


def test_packing_round_trip(spark, tmp_path):
    rows = documents(n=120)
    docs = spark.createDataFrame([r for r in rows if r[0] is not None and r is not rows[3]], TYPES)
    packed = packing.pack(docs, capacity=128)
    words = packing.load_vocabulary("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    parts = defaultdict(dict)
    for r in packed.collect():
        assert len(r["ids"]) == len(r["positions"]) == 128 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert r["positions"][a:b] == list(range(b - a))
        for doc, part, raw in packing.decode(r, words):
            assert part not in parts[doc]
            parts[doc][part] = raw
    got = {d: b"".join(p[i] for i in range(len(p))).decode() for d, p in parts.items()}
    assert got == {r["doc_id"]: r["text"] for r in docs.collect() if r["text"]}
    packing.save_binary(packed, str(tmp_path / "rows"))
    first = spark.read.parquet(str(tmp_path / "rows")).first()
    assert np.frombuffer(first["ids"], "<i4").shape == (128,)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_moving_pivot_finds_the_best_and_skips_blocks(seed):
    r = np.random.default_rng(seed)
    n, k = 64 * 40 + 7, 5
    texts = [np.sort((r.zipf(1.3, r.integers(0, 60)) % 400).astype(np.uint64)) for _ in range(n)]
    ids = r.permutation(n).astype(np.int64)
    arrays = unpack(search._build(ids, np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])))
    mean, scored, full = float(np.mean([len(t) for t in texts])), 0, 0
    for _ in range(8):
        terms = np.unique((r.zipf(1.2, 8) % 420).astype(np.uint64))
        df = np.array([sum(t in x for x in texts) for t in terms])
        terms, df = terms[df > 0], df[df > 0]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        want = []
        for i, x in zip(ids.tolist(), texts):
            tf = np.array([(x == t).sum() for t in terms])
            score = float((idf * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * len(x) / mean))).sum())
            want.append((round(-score, 9), i))
        best = []
        scored += search.shard_top(arrays, terms, idf, mean, k, best)
        full += len(np.unique(np.concatenate([np.flatnonzero([t in x for x in texts]) // search.BLOCK for t in terms])))
        assert sorted((round(-s, 9), -i) for s, i in best) == sorted(w for w in want if w[0] < 0)[:k]
    assert scored < full



def test_search_against_all_scores(spark):
    rows = documents(n=400)
    docs = spark.createDataFrame(rows, TYPES).repartition(3)
    queries = spark.createDataFrame([(1, "The w1 w2 w2 w250"), (2, "nothing here"), (3, None), (4, "w7"), (None, "w7")], "query_id long, text string")
    got = defaultdict(list)
    for r in search.top_k(docs, queries, k=7).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], round(r["score"], 6)))
    own = [(i, (t or "").lower().split()) for i, t, _, _ in rows if i is not None]
    n, mean = len(own), sum(len(w) for _, w in own) / len(own)
    df = defaultdict(int)
    for _, w in own:
        for t in set(w):
            df[t] += 1
    for q, text in ((1, "the w1 w2 w250"), (4, "w7")):
        scores = []
        for i, w in own:
            s = sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in text.split() if t in w)
            if s > 0:
                scores.append((-round(s, 6), i))
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:7])]
    assert set(got) == {1, 4}
    assert search.top_k(docs.limit(0), queries).count() == 0


def test_leaks_of_repeated_items(spark):
    """An item text that is a third of the benchmark, and items of common words only, are found in exact copies."""
    r = random.Random(5)
    text = lambda: " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(20))
    again, common = text(), [f"c{i}" for i in range(30)]
    items = [(i, again if i % 3 == 0 else text()) for i in range(90)] + [(100 + i, " ".join(r.sample(common, 20))) for i in range(20)]
    filler = lambda: " ".join("z" + r.choice("abcdefgh") for _ in range(70))
    rows = [(d, f"{filler()} {t} {filler()}", "en", "a") for d, (_, t) in enumerate(items)] + [(200, filler(), "en", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: {h["item_id"] for h in x["hits"]} for x in decontamination.find_leaks(spark.createDataFrame(rows, TYPES), bench).collect()}
    for d, (_, t) in enumerate(items):
        assert {i for i, other in items if other == t} <= got[d]
    assert got[200] == set()


def test_leaks(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(3, 8)))
    items = [(i, " ".join([*(word() for _ in range(r.randint(12, 40))), "the", "of."])) for i in range(60)] + [(60, ""), (61, None), (None, "a b c d e f")]
    filler = lambda n: " ".join(r.choice(["the", "of", "and", word()]) for _ in range(n))
    rows, want = [], {}
    for d in range(200):
        planted = r.sample(range(60), r.choice([0, 0, 1, 3]))
        rows.append((d, " ".join([filler(r.randint(0, 300)), *(items[i][1] + " " + filler(r.randint(0, 90)) for i in planted)]), "en", "a"))
        want[d] = sorted(planted)
    rows += [(200, None, "en", "a"), (201, "", "en", "a"), (202, items[5][1].upper(), "en", "a"), (203, " ".join(items[6][1].split()[:4]), "en", "a")]
    want |= {200: [], 201: [], 202: [5], 203: []}
    docs = spark.createDataFrame(rows, TYPES).withColumn("hits", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (50_000, 25):
        out = decontamination.find_leaks(docs, bench, max_items=most).collect()
        assert {x["doc_id"]: [h["item_id"] for h in x["hits"]] for x in out} == want
    assert decontamination.find_leaks(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.find_leaks(docs.limit(0), bench).count() == 0


def plain_spans(text):
    """The patterns, read character by character (addresses by one regular expression)."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    digit = lambda k: k < len(text) and text[k] in "0123456789"

    def ip(i):
        for part in range(4):
            if part and text[i : i + 1] != ".":
                return None
            i += part > 0
            if not digit(i):
                return None
            while digit(i):
                i += 1
        return i

    def card(i):
        n = i
        while digit(n) or n > i and text[n : n + 1] in (" ", "-") and digit(n + 1):
            n += 1 if digit(n) else 2
        return n if n - i > 1 else None

    def phone(i):
        if text[i : i + 1] != "+" or not digit(i + 1):
            return None
        n = i + 2
        while n < len(text) and text[n] in " ().-0123456789":
            n += 1
        ends = [k for k in range(i + 3, n) if digit(k)]
        return ends[-1] + 1 if ends else None

    def good(kind, s):
        d = [int(c) for c in s if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        doubled = [sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])]
        return 16 <= len(d) <= 19 and sum(doubled) % 10 == 0 if kind == "card" else 8 <= len(d) <= 15

    out = [("email", m.start(), m.end()) for m in email.finditer(text)]
    for kind, read in (("ip", ip), ("card", card), ("phone", phone)):
        i = 0
        while i < len(text):
            end = read(i)
            if end and good(kind, text[i:end]):
                out.append((kind, i, end))
            i = end or i + 1
    return out


def test_numbers_against_reading_by_character():
    r = random.Random(14)
    found = Counter()
    for _ in range(6000):
        text = "".join(r.choice(["1", "4", "0", "25", "255", "256", ".", ".", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "10.0.0.7", "a"]) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text
        found.update(k for k, _, _ in pii.base_spans(text))
    assert min(found[k] for k in ("ip", "card", "phone")) > 100


def test_network_reads_addresses_without_digits():
    text = "we wrote to anna [at] firma.net about it and nothing else happened that day in the whole town"
    assert any(a <= text.index("[at]") < b for a, b in pii._regions(text))
    assert any(k == "email" and a <= text.index("[at]") < b for k, a, b in pii.model_spans(pii.train(), [text])[0])
    long = "x" * 40 + "@" + "y" * 40
    assert pii._regions(f"word {long} word")[0][0] <= 5 and pii._regions(f"word {long} word")[0][1] >= 5 + len(long)
    assert pii._regions("no sign here") == []


def test_leaks_against_scoring_every_item(spark):
    """All items at or above the threshold are retrieved: items of common words, templates, one text a third of the benchmark."""
    r = random.Random(15)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.randint(4, 20))) for _ in range(40)]
    items += ["what is the name of the place where " + r.choice(vocabulary) + " lives"] * 1 + [f"what is the name of the place where {w} lives" for w in vocabulary[:15]]
    items += ["one text that many items have in common for sure"] * 28 + ["", "w1"]
    docs = []
    for i in range(60):
        t = [r.choice(vocabulary) for _ in range(r.randint(0, 300))]
        for _ in range(r.randint(0, 3)):
            own = r.choice(items).split()
            own = own[: max(1, int(len(own) * r.choice([1, 1, 0.7])))]
            at = r.randint(0, len(t))
            t[at:at] = own
        docs.append((i, " ".join(t)))
    words = [t.split() for t in items]
    n, df, mean = len(items), Counter(w for t in words for w in set(t)), sum(map(len, words)) / len(items)

    def weights(t):
        own = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(t) / max(1.0, mean))) for w, c in Counter(t).items()}
        return {w: x / sum(own.values()) for w, x in own.items()}

    grams = lambda t, k: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    share = lambda part, whole: sum(x in whole for x in part) / len(part) if part else 1.0
    per_item, size = [weights(t) for t in words], max(128, 2 * max(map(len, words)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {x["doc_id"]: {h["item_id"] for h in x["hits"]} for x in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    total = 0
    for d, text in docs:
        t, want, close = text.split(), set(), set()
        for at in range(0, max(1, len(t) - size // 2), size // 2):
            part = t[at : at + size]
            for i, (own, w) in enumerate(zip(words, per_item)):
                score = sum(x for k, x in w.items() if k in set(part))
                cut = max(1, len(own) - max(1, len(own) // 4))
                k = min(5, len(own))
                if own and score >= 0.5 - 1e-9 and share(grams(own, k), grams(part, k)) >= 0.5 and share(set(own[:cut]), set(part)) >= 0.6 and share(set(own[cut:]), set(part)) >= 0.5:
                    (close if score < 0.5 + 1e-9 else want).add(i)
        assert want <= got[d] <= want | close, d
        total += len(want)
    assert total > 300


def test_patterns():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice("a.@b-1 _+é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    text = "mail a.b@c-d.example.com, 10.0.0.256 10.0.0.25 and 4111 1111 1111 1111 +49 (30) 123-4567 é 4111-1111-1111-1112"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a.b@c-d.example.com"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 123-4567")]


def test_model_on_unseen_spans():
    data = pii.labelled_spans(300, seed=99)
    found = pii.model_spans(pii.train(), [t for t, _ in data])
    whole = [[s for s in spans if s[1] > 0 and s[2] < pii.WINDOW] for _, spans in data]
    hit = sum(s in f for w, f in zip(whole, found) for s in w)
    assert hit / sum(map(len, whole)) > 0.85


def test_personal_data(spark):
    rows = [(1, "call +1 555 123 4567 now"), (2, None), (3, ""), (4, "ä" * 500 + " 10.1.2.3 " + "ö" * 500), (4, "no digits"), (None, "x@y.zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Spans", F.lit(1))
    out = {(r["doc_id"], r["text"]): [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] for r in pii.find_personal_data(docs).collect()}
    assert out == {(i, t): pii.base_spans(t or "") for i, t in rows}
    assert pii.masked(pii.find_personal_data(docs)).where("doc_id is null").first()["text"] == "******"
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def plain_kneser_ney(texts, n_shapes=16):
    """log p(w | u, v) by the textbook's formulas on dictionaries; lower orders count the different words before."""
    said = [["<again>" if i and w == t[i - 1] else w for i, w in enumerate(t)] for t in (x.split() for x in texts)]
    vocabulary = {w for t in said for w in t} - {"<again>"}
    tri = Counter(g for t in said for g in zip(["<s>", "<s>", *t], ["<s>", *t], t) if g[2] != "<again>")
    bi = Counter(g[1:] for g in tri)
    uni = Counter(g[1] for g in bi)

    def discounts(counts):
        n = Counter(min(c, 5) for c in counts.values())
        if not n[1] or not n[2]:
            return [0.5] * 3
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2] if n[3] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] and n[4] else 1.5]
        return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]

    def level(counts, of, lower):
        d, total, left = discounts(counts), Counter(), Counter()
        for g, c in counts.items():
            total[of(g)] += c
            left[of(g)] += d[min(c, 3) - 1]
        return lambda g: lower(g) if not total[of(g)] else (counts[g] - d[min(counts[g], 3) - 1] if counts[g] else 0) / total[of(g)] + left[of(g)] / total[of(g)] * lower(g)

    p1 = level(uni, lambda g: "", lambda g: 1 / (len(vocabulary) + 2 + n_shapes))
    p2 = level(bi, lambda g: g[0], lambda g: p1(g[1]))
    return level(tri, lambda g: g[:2], lambda g: p2(g[1:]))


def test_kneser_ney_against_the_formulas(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("aaabbcdefgh") for _ in range(r.randint(0, 60))) for _ in range(40)]
    p = plain_kneser_ney(texts)
    model = quality.Scorer(quality.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_count=1))
    for text in ("a b a c h g", "c", "b d b d a h c e f g a", "a b z a b"):
        own = text.split()
        data = np.frombuffer(text.encode(), np.uint8)
        found = model.log_probabilities(*quality._tokens(data, np.array([0, len(data)])))
        own = ["<other>" if w == "z" else w for w in own]
        assert np.allclose(found, [np.log(p(g)) for g in zip(["<s>", "<s>", *own], ["<s>", *own], own)], atol=1e-4)
    for u, v in (("a", "b"), ("h", "g"), ("<s>", "<s>")):  # words, marks of the model and shapes together
        assert abs(sum(p((u, v, w)) for w in [*"abcdefgh", "<again>", "<s>", *range(16)]) - 1) < 1e-9


def test_quality_on_held_out_labels(spark):
    r = random.Random(6)
    vocabulary = [f"wo{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    good = lambda: " ".join(r.choice(vocabulary[: r.choice([20, 300])]) for _ in range(80))
    rows = [(i, good(), "en", "a") for i in range(600)]
    rows += [(i, good().upper().replace(" ", "!! "), "en", "a") for i in range(600, 660)]
    rows += [(i, good() + " scum " + good() + " moron", "en", "a") for i in range(660, 720)]
    rows += [(720, None, None, "a"), (721, "", "en", "a"), (None, good(), "xx", "a")]
    labels = [(i, int(not 600 <= i < 660), int(i >= 660)) for i in range(0, 720, 2)]
    docs = spark.createDataFrame(rows, TYPES).withColumn("keep", F.lit(3))
    out = {x["doc_id"]: x for x in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_train=150).collect()}
    unseen = [i for i in range(1, 720, 2)]
    assert all(not out[i]["keep"] for i in unseen if i >= 600)
    assert sum(out[i]["keep"] for i in unseen if i < 600) > 290
    assert out[720]["keep"] and out[721]["keep"] and out[720]["perplexity"] is None and out[None]["keep"]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, empty).where("keep").count() == len(rows)
