"""Counts, models and thresholds of the quality operator come from all labelled documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from binweave.llm import quality
from tests.llm.test_operators import TYPES, plain_kneser_ney

N = 2_300  # good documents and toxic ones each: above the 2,000 that were read once


@pytest.fixture
def labelled(spark, monkeypatch):
    """Documents and labels, and what the model and the markers are made of."""
    rows = [(i, f"plain words {i % 7} of text", "en", "a") for i in range(N)] + [(i, f"scum words {i}", "en", "a") for i in range(N, 2 * N)]
    docs = spark.createDataFrame(rows, TYPES)
    labels = spark.createDataFrame([(i, 1, int(i >= N)) for i in range(2 * N)], "doc_id long, quality int, toxic int")
    seen, train, find_markers = {}, quality.train, quality.find_markers
    monkeypatch.setattr(quality, "train", lambda sample, *a, **k: (seen.update(taught=sample.count()), train(sample, *a, **k))[1])
    monkeypatch.setattr(quality, "find_markers", lambda sample, *a, **k: (seen.update(marked=sample.count()), find_markers(sample, *a, **k))[1])
    return docs, labels, seen


def test_all_labelled_documents_are_read(labelled):
    docs, labels, seen = labelled
    out = quality.classify(docs, labels)
    assert seen == {"taught": N, "marked": 2 * N}
    assert out.where("keep and doc_id < 2300").count() == N and out.where("keep").count() == N


def test_all_labelled_documents_are_read_in_the_pipeline(spark, labelled, monkeypatch):
    docs, labels, seen = labelled
    monkeypatch.setattr(corpus_pipeline, "read", lambda spark, folder, table: labels)
    assert corpus_pipeline.quality(spark, docs, "").count() == N
    assert seen == {"taught": N, "marked": 2 * N}


def test_scores_by_bucket_against_the_formulas(spark):
    """The whole text's model and its halves', dealt to buckets and asked in rounds."""
    r = random.Random(8)
    texts = [" ".join(r.choice("aaabbcdefgh") for _ in range(r.randint(0, 60))) for _ in range(60)]
    sample = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, half int")
    model = quality.train(sample, min_count=1, buckets=7)
    plain = [plain_kneser_ney(x) for x in (texts, texts[::2], texts[1::2])]
    asked = [(10 * i + m, m, 1, t) for i, t in enumerate(["a b a c h g", "c", "", "b d b d a h c e f g a", *texts[:5]]) for m in range(3)]
    docs = spark.createDataFrame(asked + asked[:1], "key long, model int, good int, text string")
    out = {x["key"]: x for x in quality.score(docs, model, np.zeros(0, np.uint64)).collect()}
    assert len(out) == len(asked)
    for key, m, _, text in asked:
        said = text.split()
        said = ["<again>" if i and w == said[i - 1] else w for i, w in enumerate(said)]
        expected = sum(np.log(plain[m](g)) for g in zip(["<s>", "<s>", *said], ["<s>", *said], said))
        assert out[key]["n_words"] == len(said) and abs(out[key]["log_p"] - expected) < 1e-4 * max(1, len(said))


def test_quantiles_are_exact(spark):
    r = random.Random(9)
    rows = [(r.choice(["en", "de", None]), r.lognormvariate(3, 1)) for _ in range(5_000)]
    out = quality._quantiles(spark.createDataFrame(rows, "lang string, p double").withColumn("p", F.col("p")), (0.01, 0.999), accuracy=100)
    for lang in ("en", "de", None, ...):
        mine = sorted(p for k, p in rows if lang is ... or k == lang)
        assert out[lang] == [mine[int(np.ceil(q * len(mine))) - 1] for q in (0.01, 0.999)]


@pytest.fixture
def shared_word(spark):
    """A word of all toxic documents and of as many that are neither good nor toxic; one unlabelled document has it, one the toxic word too."""
    text = "plain words of text " * 5
    rows = [(i, f"{text}{i % 30}", "en", "a") for i in range(300)] + [(i, f"{text}{i} scum notice", "en", "a") for i in range(300, 320)]
    rows += [(i, f"{text}{i} notice", "en", "a") for i in range(320, 340)] + [(340, f"{text}notice", "en", "a"), (341, f"{text}scum", "en", "a")]
    labels = [(i, int(i < 300), int(300 <= i < 320)) for i in range(340)] + [(342, 0, None)]
    return spark.createDataFrame(rows, TYPES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_markers_count_labelled_documents_that_are_neither_good_nor_toxic(shared_word):
    out = {x["doc_id"]: x["n_markers"] for x in quality.classify(*shared_word).collect()}
    assert out[340] == 0 and out[341] == 1 and out[300] == 1 and not any(out[i] for i in range(320, 340))


def test_pipeline_keeps_a_word_that_labels_do_not_tie_to_toxic_text(spark, shared_word, monkeypatch):
    docs, labels = shared_word
    monkeypatch.setattr(corpus_pipeline, "read", lambda spark, folder, table: labels)
    kept = {x["doc_id"] for x in corpus_pipeline.quality(spark, docs, "").collect()}
    assert 340 in kept and 341 not in kept and not kept & set(range(300, 320))
