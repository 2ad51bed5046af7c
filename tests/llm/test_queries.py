"""The registered queries on the smallest tables against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__
from binweave.llm import mixing, pii
from binweave.llm._spark import read
from tests.compare import database, difference
from tests.llm.test_near_dedup import brute as components
from tests.llm.test_repeats import brute as repeats

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in read(spark, FOLDER, "documents").collect())


def rows(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, FOLDER).collect()}


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_op1(spark, docs):
    out = rows(spark, "op1_kd_sharding")
    sums = defaultdict(int)
    assert len(out) == len(docs)
    for i, text, _, _ in docs:
        raw = text.encode()
        assert (out[i]["size"], out[i]["text_crc32"], out[i]["law"], out[i]["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sums[out[i]["shard"]] += out[i]["size"]
    assert sorted(sums) == list(range(8))


def test_op2(spark, docs):
    out = rows(spark, "op2_bilstm_pii")
    for i, text, _, _ in docs:
        base = pii.base_spans(text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base, key=lambda s: (pii.KINDS.index(s[0]), s[1])))
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert out[i]["base_sha256"] == sha(line.encode()) and set(filter(None, line.split(","))) <= set(out[i]["spans"].split(","))


def test_op3(spark, docs):
    seen = defaultdict(list)
    for r in QUERIES["op3_token_packing"](spark, FOLDER).collect():
        for d, p in zip(r["doc_ids"], r["parts"]):
            seen[d].append(p)
    assert sorted(seen) == [i for i, t, _, _ in docs if t] and all(sorted(p) == list(range(len(p))) for p in seen.values())


def test_op4(spark):
    assert difference(spark, database(FOLDER), FOLDER, QUERIES["op4_bm25_top_k"], SQL["op4_bm25_top_k"]) is None


def test_op5(spark, docs):
    out = rows(spark, "op5_suffix_dedup")
    for (i, text, _, _), (kept, gone, runs) in zip(docs, repeats([d[:2] for d in docs], 50, lambda t: t.encode())):
        r = out[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(text.encode()), gone, runs, sha(bytes(kept)))


def test_op7(spark, docs):
    out = rows(spark, "op7_source_mixing")
    total, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, text, _, source in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        assert out[i]["size"] == n and out[i]["taken"] <= 3 * n
        total[source] += n
        taken[source] += out[i]["taken"]
        largest[source] = max(largest[source], n)
    names = sorted(total)
    for s, t in zip(names, mixing.targets([total[s] for s in names], mixing.rotating_weights(names), 3)):
        assert abs(taken[s] - t) <= largest[s] / 2 + 1


def test_op8(spark, docs):
    out = rows(spark, "op8_rlz_dedup")
    for (i, text, _, _), (kept, gone, _) in zip(docs, repeats([d[:2] for d in docs], 13, lambda t: t.encode().split())):
        assert (out[i]["n_words"], out[i]["n_removed"], out[i]["kept_sha256"]) == (len(text.encode().split()), gone, sha(b" ".join(kept)))


def test_op6_and_op9(spark, docs):
    assert len(rows(spark, "op6_kneser_ney_quality")) == len(docs)
    found = rows(spark, "op9_benchmark_decontamination")
    items = {r["item_id"]: " ".join(r["text"].split()) for r in read(spark, FOLDER, "benchmark").collect()}
    for i, text, _, _ in docs:
        flat = " ".join(text.split())
        assert {k for k, t in items.items() if t in flat} <= set(found[i]["item_ids"])


def test_op10(spark, docs):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op10_chosen_path_near_dedup"](spark, FOLDER).collect())
    assert got == components([d[:2] for d in docs], 2, 80)


def test_pipeline(spark, docs):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert 0 < len({r["doc_id"] for r in out}) < len(docs) and {r["shard"] for r in out} <= set(range(8))
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(out[0].asDict())


def terms(text):
    """Lower-cased words without up to three ASCII marks at either end."""
    out = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})):
        mark = lambda c: "!" <= c <= "~" and not c.isalnum()
        for _ in range(3):
            w = w[:-1] if len(w) > 1 and mark(w[-1]) else w
            w = w[1:] if len(w) > 1 and mark(w[0]) else w
        out.append(w)
    return out


def contaminated(texts, items):
    """Whether some passage scores half of what an item does against itself, and holds enough of its shingles, question and answer."""
    words = [terms(t) for t in items]
    n, df, mean = len(items), Counter(w for t in words for w in set(t)), max(1.0, sum(map(len, words)) / len(items))
    weights = []
    for t in words:
        own = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w, c in Counter(t).items()}
        weights.append({w: x / sum(own.values()) for w, x in own.items()})
    grams = lambda t, k: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    share = lambda part, whole: sum(x in whole for x in part) / len(part) if part else 1.0
    size, out = max(128, 2 * max(map(len, words))), []
    for text in texts:
        t, hit = terms(text), False
        for at in range(0, max(1, len(t) - size // 2), size // 2):
            part = t[at : at + size]
            here = set(part)
            for own, w in zip(words, weights):
                if own and sum(x for k, x in w.items() if k in here) >= 0.5:
                    cut, k = max(1, len(own) - max(1, len(own) // 4)), min(5, len(own))
                    hit |= share(grams(own, k), grams(part, k)) >= 0.5 and share(set(own[:cut]), here) >= 0.6 and share(set(own[cut:]), here) >= 0.5
        out.append(hit)
    return out


def test_pipeline_by_hand(spark, docs):
    """Near duplicates by all pairs, leaks by scoring every item, and targets, each over what the stages before have kept."""
    import corpus_pipeline

    keep = {i for i, r in rows(spark, "op6_kneser_ney_quality").items() if r["keep"]}
    after = [d for d in docs if d[0] in keep]
    alone = {i for i, _, _, kept in components([d[:2] for d in after], 5, 80) if kept}
    after = [d for d in after if d[0] in alone]
    items = [r["text"] for r in read(spark, FOLDER, "benchmark").collect()]
    clean = [d for d, hit in zip(after, contaminated([d[1] for d in after], items)) if not hit]
    assert 0 < len(clean) < len(after) < len(keep) < len(docs)
    out = corpus_pipeline.run(spark, FOLDER).collect()
    of, texts = {d[0]: d[3] for d in clean}, {d[0]: d[1] for d in clean}
    assert {r["doc_id"] for r in out} <= set(of) and all(r["text"] == texts[r["doc_id"]] and r["source"] == of[r["doc_id"]] for r in out)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    total, taken, largest = Counter(), Counter(), Counter()
    for i, s in of.items():
        total[s] += words[i]
        largest[s] = max(largest[s], words[i])
    for r in out:
        taken[r["source"]] += words[r["doc_id"]]
    names = sorted(total)
    for s, t in zip(names, mixing.targets([total[s] for s in names], mixing.rotating_weights(names), 3)):
        assert abs(taken[s] - t) <= largest[s] + 1  # whole documents only
    copies = Counter(r["doc_id"] for r in out)
    assert max(copies.values()) <= 3
    slots, sizes = defaultdict(list), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += len(r["text"].encode()) + 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 3 * max(len(t.encode()) + 1 for t in texts.values())


def test_stages_on_awkward_rows(spark):
    """Nulls in all columns, empty and repeated rows, no rows."""
    import corpus_pipeline

    table = read(spark, FOLDER, "documents")
    odd = [(None, None, None, None, None), (5, "", "en", "src1", 0), (5, "", "en", "src1", 0), (6, "a few words", None, None, 11), (7, "ä " * 30_000, "xx", "src2", 60_000)]
    for rows_ in (odd, []):
        docs = spark.createDataFrame(rows_, table.schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect() or [], stage(spark, docs, FOLDER).schema)
            assert name == "sharding" or docs.columns == table.columns
        assert docs.count() == 0 if not rows_ else docs.count() > 0
