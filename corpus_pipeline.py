"""The corpus pipeline: quality filter, exact dedup, near dedup, source mix, tokens.

Every stage takes rows with the columns of documents. Null and empty texts stay where nothing rejects them (the quality
score of an empty text decides as any other), are copies of each other for the exact dedup, link with nothing and take
no words; null sources are one source, the last; null ids never leave by an id, so near copies among them all stay;
repeated rows are exact copies. Further columns are carried along. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, lsm_dedup, mixing, ngram_join, quality_gam
from tracewell.storage import cut

#: SQL can express neither the classifier nor the tokens; tests/llm/test_llm.py holds each stage against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of sf_dir, doesn't reject: scores of 0.3 and more."""
    return quality_gam.keep_good(docs, quality_gam.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest original stays, of equally long ones the smallest doc_id."""
    return lsm_dedup.keep_best(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.75) the smallest doc_id stays."""
    return ngram_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents: repeated as often as they are taken, cut where their source's budget ends."""
    mixed = mixing.draw(docs)
    return mixed.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else mixed


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_decode(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("mixing sources", mix_sources), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read back; the last one's rows:
    doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
