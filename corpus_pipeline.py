"""Documents through quality rules, near-dedup, repeated-passage removal, secret redaction and packing.

Every stage is a function of (spark, docs, sf_dir) and is run on the written result of the one before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm import packing, quality_rules, secrets, simhash, suffix_dedup
from pelagia.llm.common import table
from pelagia.llm.queries import vocabulary
from pelagia.session import shared_folder

#: SQL cannot express the learnt and iterative stages.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules keep; the rules' accuracies are learnt from these documents."""
    counted = quality_rules.rule_stats(docs)
    judged = quality_rules.judge(counted, quality_rules.learn(counted))
    return judged.filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (five-word runs, similarity 0.8), the one with the least id.

    Rows without an id stay. A group keeps one row: of rows that repeat its least id with different texts, one of these.
    """
    named = simhash.similar_texts(docs).filter("id is not null")
    first = named.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("first")).select("first.*")
    kept = docs.withColumn("digest", F.xxhash64("text")).join(first.select(F.col("id").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    return kept.dropDuplicates(["doc_id", "digest"]).select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 50-byte strings of earlier documents; a character cut in two goes as a whole."""
    left = suffix_dedup.remove_repeats(docs, carry=("lang", "source", "n_chars"), as_text=True)
    return left.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source",
                       F.when(F.size("starts") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the secrets replaced that the forest keeps after false-positive removal."""
    redacted = secrets.redact(docs, secrets.learn(docs))
    return redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 2048."""
    return packing.best_fit_packing(docs, vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", passages), ("secret scans", redaction), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
