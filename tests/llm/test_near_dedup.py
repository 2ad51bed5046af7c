"""Components of the similarity join against comparing all pairs."""

import random

from binweave.llm.near_dedup import near_duplicates


def brute(rows, n, share):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = [1 << 63 if r[0] is None else r[0] for r in rows]
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 1 << 64), ids[i])
    return sorted((ids[i], len(sets[i]), least[find(i)], ids[i] == least[find(i)]) for i in range(len(rows)))


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "The"]
    text = lambda k: [r.choice(vocabulary) for _ in range(k)]
    rows = []
    for _ in range(12):
        base = text(r.randint(3, 120))
        for _ in range(r.choice([1, 2, 6])):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 12))):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            rows.append(" ".join(t))
    base = text(90)
    for _ in range(60):  # a family larger than a node
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice(vocabulary)
        rows.append("  ".join(t))
    rows += ["", None, "  \n", "one", "one", "ONE", "one two", rows[0], rows[0].upper()]
    out = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    out += [(None, rows[3]), (None, "quite alone here"), out[5], (4, "another text under a used id")]
    r.shuffle(out)
    return out


def test_against_all_pairs(spark):
    for seed, n in ((1, 2), (2, 5)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, f int").repartition(3)
        got = sorted((1 << 63 if r.doc_id is None else r.doc_id, r.n_shingles, 1 << 63 if r.component_id is None else r.component_id, r.kept) for r in near_duplicates(docs, n=n).collect())
        assert got == brute(rows, n, 80)


def test_groups_of_a_large_family(spark):
    """Groups of three in a family of one vocabulary, a third of the rows: all its nodes stay large, and no leader is near.

    One level leaves nodes as large here as four do in a family some hundred times as large.
    """
    r = random.Random(4)
    base, texts = [f"b{i}" for i in range(100)], []
    for _ in range(150):
        own = r.sample(base, 75)
        texts += [own, own[:-8], own[8:]]  # the first is linked to both others, they not with each other
    texts += [[f"x{i}_{j}" for j in range(5)] for i in range(900)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    r.shuffle(rows)
    got = sorted(tuple(x) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=1, depth=1).collect())
    assert got == brute(rows, 1, 80)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
