"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; every stage
but the last returns the columns of documents. Stages are written to the shared folder and read
again, so each of them starts from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontamination, line_dedup, near_dedup, packing, quality_rules
from helixframe.llm.common import Scratch, free_name, if_small


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and blank texts are rejected, repeated rows and null ids are judged alike."""
    verdict = free_name(docs, quality_rules.REJECTED_BY)
    return quality_rules.cascade(docs).filter(F.col(verdict).isNull()).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more hold; n_chars follows the text.

    A row with a null text stays as it is; repeated rows count as documents of their own, rows with null ids too.
    """
    text = F.when(F.col("text").isNotNull(), F.col(free_name(docs, line_dedup.KEPT)))
    kept = line_dedup.drop_frequent_lines(docs, min_docs=10)
    changed = {"text": text, "n_chars": F.coalesce(F.length(text).cast("long"), "n_chars")}
    return kept.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    Texts without words and rows with null ids stay; all rows of an id stay or go together.
    """
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"), size=5, share=80)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = if_small(Scratch(spark, "pipeline").save(gone, "copies"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with its own or with other numbers and names.

    Rows with null ids are judged by their text; of rows that share an id only those with a contaminated text go.
    """
    found = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.select(F.col("doc_id").alias("__gone"), F.col("__text").alias("__gone_text")).distinct()
    gone = if_small(Scratch(spark, "pipeline").save(gone, "leaks"))
    same = docs["doc_id"].eqNullSafe(gone["__gone"]) & (F.xxhash64(docs["text"]) == gone["__gone_text"])
    return docs.join(gone, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens; null texts are the end token alone, repeated rows
    are packed as often as they occur."""
    return packing.packed(docs).select(*packing.COLUMNS)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", decontaminate), ("packing", pack)]

#: SQL has no tokenizer, so the last stage can't be expressed; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
