"""Documents to training shards: quality, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.llm._spark import durable, read
from binweave.llm.decontamination import find_leaks
from binweave.llm.mixing import mix
from binweave.llm.near_dedup import near_duplicates
from binweave.llm.quality import classify
from binweave.llm.sharding import shard


def _renamed(docs: DataFrame) -> DataFrame:
    """No column of the input is named like one that an operator adds."""
    return docs.toDF(*(f"in_{c}" for c in docs.columns))


def _restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col(f"`in_{c}`").alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of improbable text or with words of toxic text.  Null and empty texts stay; rows that repeat are judged alike."""
    return _restored(classify(_renamed(docs), read(spark, sf_dir, "labels"), id_col="in_doc_id", text_col="in_text", lang_col="in_lang").where("keep"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 or more.  Texts without words stay; rows that repeat an id go or stay together, as do those with a null id."""
    kept = near_duplicates(docs, n=5, share=80).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that contain a benchmark item.  Null and empty texts stay."""
    return _restored(find_leaks(_renamed(docs), read(spark, sf_dir, "benchmark"), text_col="in_text").where("not contaminated"), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents of small sources repeat, documents of large ones are drawn.  Texts without words come once per epoch; null is a source."""
    mixed = mix(_renamed(docs), id_col="in_doc_id", text_col="in_text", source_col="in_source").where("copies > 0")
    return _restored(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents (but those named like an output) with size, text_crc32, shard of eight and place in it."""
    return shard(docs, shards=8)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Perplexities, components and weighted draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
