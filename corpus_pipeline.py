"""A corpus pipeline: documents in, packed training windows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows as Parquet into the shared folder and reads them again for the next.
All but the last return the columns of documents; a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import ngram_join, packing, quality, secrets, substring_dedup, textkit, tokens


def _as_documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now has."""
    columns = [F.when(F.col("text").isNotNull(), F.length("text").cast("long")).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in like.columns]
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; their model is fitted on this stage's
    input, with the table of labels."""
    measured = textkit.written(quality.measure(docs), "rule-statistics")
    return quality.keep(docs, quality.fit(measured, textkit.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest
    doc_id. Documents without a doc_id stay, and so do other texts of a repeated one."""
    return ngram_join.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that an earlier document has in a window of 13."""
    return _as_documents(substring_dedup.dedup(docs), docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    return _as_documents(secrets.redact(docs), docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secret_spans),
    ("packing", packed_windows),
]

#: The forest, and retrieval, aren't expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = textkit.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        at = textkit.fresh_dir(spark, name.replace(" ", "-").lower())
        with textkit.scope(spark):  # what a stage leaves behind, and its input, go once it is written
            docs = textkit.written(stage(spark, docs, sf_dir), name, at)
        textkit.remove(spark, *before)
        before = [at]
    return docs
