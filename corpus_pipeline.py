"""Corpus preparation: five stages from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import cotrain, decontam, minhash, packing, pii
from corpusloom.llm.common import table, workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return cotrain.keep_good(docs, cotrain.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id.

    Rows that repeat both an id and its text are one document; different texts of one id all stay if the id does.
    """
    stay = minhash.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    own = docs.join(stay, "doc_id", "left_semi").select(docs.columns)
    mark = "text_digest"
    while mark in docs.columns:
        mark += "_"
    own = own.withColumn(mark, F.sha2("text", 256)).dropDuplicates(["doc_id", mark]).drop(mark)
    return own.union(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    bad = found.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & F.xxhash64("text").eqNullSafe(F.col("bad_hash"))
    return docs.join(bad, same, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the names of its kinds."""
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a training sequence."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL can't express the classifier and the random field; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return docs
