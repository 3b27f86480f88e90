"""A training-data pipeline over ``documents``: quality rules, line dedup, near-duplicate removal, packing.

Each stage works on all that its predecessor kept, written as Parquet in between. No stage but the first is expressible
in SQL on whole tables (similarity joins, tokenizers), so the pipeline has no oracle; each stage is tested against brute force.

Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names are taken as the stages' operators say. A document
with a null, empty or wordless text is rejected by the quality rules. One that line dedup leaves without a word, as all its
lines are in earlier documents, is dropped there: it has nothing left that packing could use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlume.llm import line_dedup, ngram_join, packing, quality_rules
from wardlume.llm.shared import WORD_CLASS, unused, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold every rule of the threshold table."""
    return quality_rules.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches, unless no word is left; n_chars follows the text."""
    removed = unused(docs, "removed_lines")
    out = line_dedup.line_dedup(docs, removed=removed).filter((F.size(removed) == 0) | F.col("text").rlike(WORD_CLASS))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    drop = ngram_join.ngram_join(docs).filter("component_id is not null and doc_id <> component_id").select("doc_id")
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 4096."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
