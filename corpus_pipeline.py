"""A training corpus from ``documents``: five stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.

Odd input, in every stage: null and empty texts pass (they are clean, and one group for the near-dedup); rows with a
null id are judged by their texts and never grouped; rows that share an id and a text count as one document, and rows
that share only an id are documents of their own; empty tables give empty tables; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.llm import decontaminate, jaccard, packing, secret_scan, simhash, toxicity
from roadlake.llm.shared import Scratch, table

#: Near duplicates: five-word shingles, Jaccard similarity of 0.8 or more, counted exactly.
SHINGLE_WORDS = 5


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier chain rejects as toxic."""
    return toxicity.keep_clean(spark, docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates."""
    groups = simhash.wide_groups(spark, docs, size=SHINGLE_WORDS).where("doc_id is not null")
    one = ["doc_id", "text_hash", "text_chars"]  # rows that share an id and have different texts are judged apart
    out = groups.groupBy(*one).agg(F.min("component_id").alias("least"), F.count("*").alias("rows"))
    at, chars = jaccard.text_hash(F.col("text"))

    def of(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
        marked = rows.select(F.struct(*docs.columns).alias("row"), "doc_id", at.alias("text_hash"), chars.alias("text_chars"))
        return marked.join(found.select(one), one, how).select("row.*")

    kept = of(docs, out.where("least < doc_id"), "left_anti")
    repeated = out.where("least = doc_id and rows > 1")
    if not repeated.limit(1).count():
        return kept
    once = of(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return of(kept, repeated, "left_anti").unionByName(once)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that repeat ten words in a row of a test item, or a whole shorter one."""
    return decontaminate.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows the texts that change."""
    before = docs.withColumn("_before", F.length("text"))
    out = secret_scan.redact(before)
    return out.withColumn("n_chars", F.when(F.length("text") != F.col("_before"), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets of least padding and token-budget batches: a row for each document."""
    return packing.pack_texts(spark, docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("secret_scan", secrets),
    ("packing", batches),
]

#: SQL has neither the classifier nor the fingerprints; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
