"""One query per operator over its whole table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, mixing, near_dedup, neighbours, packing, periodic, pii, quality, ranked, rlz_dedup, search, sharding, suffix_dedup
from ._spark import read


def op1_kd_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards of near equal bytes, at medians of size and language."""
    out = sharding.shard(read(spark, folder, "documents").select("doc_id", "text", "lang"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_bilstm_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and hash of the patterns' spans, and all spans, in every whole text."""
    out = pii.find_personal_data(read(spark, folder, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["base"])
    return out.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2(F.encode(pii.joined(base), "UTF-8"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op3_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as rows of 2048 token ids."""
    return packing.pack(read(spark, folder, "documents").select("doc_id", "text"), capacity=2048)


def op4_bm25_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best of all documents for every benchmark item whose id is divisible by 20."""
    queries = read(spark, folder, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    out = search.top_k(read(spark, folder, "documents").select("doc_id", "text"), queries, k=10)
    return out.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents contain."""
    out = decontamination.find_leaks(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"))
    return out.select("doc_id", F.transform("hits", lambda h: h["item_id"]).alias("item_ids"), F.size("hits").cast("long").alias("n_items"), "contaminated")


def op10_chosen_path_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return near_dedup.near_duplicates(read(spark, folder, "documents").select("doc_id", "text"), n=2, share=80)


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes covered by 50-byte strings that a document with a smaller id has too."""
    out = suffix_dedup.drop_repeated_bytes(read(spark, folder, "documents"), length=50)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_kneser_ney_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity of every document under a model of labelled good text, and whether it is kept."""
    out = quality.classify(read(spark, folder, "documents").select("doc_id", "text", "lang"), read(spark, folder, "labels"))
    return out.drop("text")


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Sources weigh 1, 2, 3, repeating; no target above three times its source."""
    out = mixing.mix(read(spark, folder, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_rlz_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words covered by 13-word windows that a document with a smaller id has too."""
    out = rlz_dedup.drop_repeated_words(read(spark, folder, "documents"), length=13)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def planted_repeats() -> Column:
    """The text of a document; of every tenth (by the checksum of its id) the words from some place on repeat a stretch that begins there."""
    found, h = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:  # the words are a variable here, so they are read once
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")).otherwise("")

    return F.when(h % 10 == 0, F.get(F.transform(F.array(found), repeated), F.lit(0))).otherwise(F.col("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of at least 12 words and two periods in every document, the longest of them, and the words left when repeats go."""
    docs = read(spark, folder, "documents").select("doc_id", planted_repeats().alias("text"))
    found = periodic.find_runs(docs).select("doc_id", "runs", "collapsed")
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    out = found.withColumn("best", best).withColumn("lines", F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""))
    length, period = -F.col("best.by"), F.col("best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), F.sha2(F.encode("lines", "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op12_sparse_product_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    return ranked.rank(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"), k=10)


def op13_prefix_forest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest found of all other vectors for every vector whose id is divisible by 50."""
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_kd_sharding, op2_bilstm_pii, op3_token_packing, op4_bm25_top_k, op5_suffix_dedup, op6_kneser_ney_quality,
        op7_source_mixing, op8_rlz_dedup, op9_benchmark_decontamination, op10_chosen_path_near_dedup, op11_periodic_runs,
        op12_sparse_product_search, op13_prefix_forest_neighbours,
    )
    return {f.__name__: f for f in every}


_SPACE = "[^ \\t\\n\\x0B\\f\\r]+"
_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    words = f"regexp_extract_all({_LOWER}, '{_SPACE}')"
    terms = f"regexp_extract_all({_LOWER}, '{_TERM}')"
    return {
        "op4_bm25_top_k": f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
tf AS (SELECT doc_id, len AS length, w, count(*) AS f FROM (SELECT doc_id, len(w) AS len, unnest(w) AS w FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, unnest({words}) AS w FROM benchmark WHERE item_id % 20 = 0),
df AS (SELECT w, count(*) AS df FROM tf WHERE w IN (SELECT w FROM q) GROUP BY w),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM q JOIN df USING (w) JOIN tf USING (w), stats GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
            "op12_sparse_product_search": f"""
WITH d AS (SELECT doc_id, {terms} AS w FROM documents), stats AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
tf AS (SELECT doc_id, n, w, count(*) AS f FROM (SELECT doc_id, len(w) AS n, unnest(w) AS w FROM d) GROUP BY ALL),
q AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS w FROM benchmark) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf WHERE w IN (SELECT w FROM q) GROUP BY w),
weight AS (SELECT w, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM df, stats),
s AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * f) // (1000 * f + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN weight USING (w) JOIN tf USING (w), stats GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    }
