"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm import line_dedup, near_dup, packing, pii, quality_classifier
from formline.session import new_path, stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``, the number of characters brought up to date where there is one."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return changed.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on these documents, rejects."""
    return quality_classifier.fit(docs).keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts blocks of lines that an earlier document holds; a document of which nothing is left keeps its row."""
    return _like(docs, line_dedup.dedup_lines(docs, places=None))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near-duplicates; rows without an id stay.

    Documents without words, such as the line stage leaves of whole copies, are one group too.
    """
    verdict = near_dup.near_duplicates(docs, width=5, percent=80)
    verdict = stored(verdict.select("doc_id", "n_shingles", "kept"), "verdict")
    blank = verdict.filter("n_shingles = 0").agg(F.min("doc_id").alias("doc_id")).first()["doc_id"]
    extra = (F.col("n_shingles") == 0) & (F.col("doc_id") > F.lit(blank))
    dropped = verdict.filter(~F.col("kept") | F.coalesce(extra, F.lit(False))).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each piece of personal data in its place."""
    return _like(docs, pii.mask_personal_data(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2048."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

# No stage can be told in SQL (a fitted model, alignments, tokens): tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
