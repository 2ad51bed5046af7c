"""What cuts leave behind in the driver."""

import time

from pyspark.sql import functions as F

from binweave.llm import near_dedup
from binweave.llm._spark import durable


def test_a_cut_frees_the_plans_that_python_has_dropped(spark):
    dropped = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    assert dropped.count() == 7
    seen = spark.sparkContext._jvm.java.lang.ref.WeakReference(dropped._jdf)
    del dropped
    time.sleep(2)  # py4j tells the JVM once a second
    assert durable(spark.range(5)).count() == 5
    assert seen.get() is None


def test_pairs_of_near_duplicates_are_cut_at_each_level(spark, monkeypatch):
    found = []

    def watched(*args, whole=near_dedup.candidates):
        found.append(whole(*args)[0])
        return whole(*args)

    monkeypatch.setattr(near_dedup, "candidates", watched)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, f"{text} more"), (3, "another text of six words")], "doc_id long, text string")
    out = near_dedup.near_duplicates(docs).orderBy("doc_id").select("doc_id", "component_id", "kept").collect()
    assert [tuple(r) for r in out] == [(1, 1, True), (2, 1, False), (3, 3, True)]
    assert "Join" not in found[0]._jdf.queryExecution().toString()
