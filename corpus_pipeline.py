"""A corpus pipeline of five operators: each stage's result is written as Parquet in the shared folder and is the next one's input.

Every stage but the last returns the columns of ``documents``. Null texts count as empty, null sources and languages
as values of their own; repeated rows are reduced by the exact stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import table, written
from keyloom.llm.exact_dedup import keep_last_copies
from keyloom.llm.kneser_ney import classify
from keyloom.llm.packing import best_fit_packing
from keyloom.llm.queries import tokenizer
from keyloom.llm.secret_scan import redact_live
from keyloom.llm.simhash import keep_one_of_each


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    return classify(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return keep_last_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 or more join, by five-word shingles, the document with the smallest id.

    Decided row by row: a repeated id loses no text that has no near copy.
    """
    return keep_one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of live secrets; n_chars of those texts follows.

    Owners are counted over the whole corpus: in what deduplication left, a value that many copied would look like one's own.
    """
    mark = "[SECRET]"
    out = redact_live(docs, mark=mark, corpus=table(spark, sf_dir, "documents"))
    chars = F.when(F.contains(F.col("text"), F.lit(mark)), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    out = best_fit_packing(docs.select("doc_id", "text"), tokenizer("word_bpe_49k.json"), keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
