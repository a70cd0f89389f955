"""Documents to token files in five stages; each stage's decisions hold for the next."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tradebook.llm import decontamination, mixing, near_duplicates, quality, queries, token_files
from tradebook.llm.common import pin, small, written
from tradebook.session import scratch_dir


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents less those given by (doc_id, text_hash), with all their columns."""
    gone = written(rejected.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct(), "rejected")
    gone = small(gone, gone.count())
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_text"])
    return docs.join(gone, same, "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good and not toxic by the co-trained views."""
    return quality.keep_accepted(docs, queries.read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id; of rows that repeat it, any."""
    found = near_duplicates.near_duplicates(docs).groupBy("doc_id", "text_hash").agg(
        F.max("kept").alias("kept"), F.min("kept").alias("all_kept")
    )
    found = written(found.filter("not all_kept"), "not-kept")
    left = _without(docs, found.filter("not kept"))
    repeated = written(found.filter("kept").select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_text")), "repeated")
    n = repeated.count()
    if not n:
        return left
    same = left["doc_id"].eqNullSafe(repeated["of_id"]) & (F.xxhash64(left["text"]) == repeated["of_text"])
    whole = F.struct(*[left[c] for c in left.columns]).alias("row")  # so that no name of theirs can clash
    copies = left.join(small(repeated, n), same, "left_semi").select("doc_id", F.xxhash64("text").alias("text_hash"), whole)
    once = copies.dropDuplicates(["doc_id", "text_hash"]).select("row.*")
    return left.join(small(repeated, n), same, "left_anti").union(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontamination.decontaminate(docs, queries.read(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their files and rows in the order of the mix."""
    return mixing.mixed(docs, queries.SHARES)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix, which is the order of the rows in the files read.

    Documents that come from no files go by doc_id. Returns doc_id, start, n_tokens, ids_crc32.
    """
    pin(spark)
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
        placed = docs.select("doc_id", "text", part.alias("part"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return token_files.tokenise(docs, queries.TOKENIZER)
    return token_files.tokenise(placed, queries.TOKENIZER, ["part", "row"])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_files", tokens),
]

# Sampling, models and signatures are beyond SQL; the tests hold each stage to its operator or to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written as Parquet and read again."""
    pin(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_dir(spark, "pipeline")
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
