"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, substring dedup, best-fit packing.

Defined cases for every stage: null and empty texts are documents like any other; decisions are made for rows, not
for doc_ids, so rows that share an id (or have none) are kept or dropped one by one, and of rows that repeat each other
wholly exactly one stays after exact dedup; ties fall to the row read first; an empty table gives no rows; documents
may have further columns of any names, which the stages (but the last) return as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import staged
from sparquill.llm.exact_dedup import exact_groups
from sparquill.llm.packing import pack_documents
from sparquill.llm.simhash import near_groups
from sparquill.llm.substring_dedup import without_repeats
from sparquill.llm.toxicity import without_toxic


def _numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """docs with a number for each row, written once so that it stays, and the number's column (a name docs don't have)."""
    name = "row"
    while name in docs.columns:
        name += "_"
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), label), name


def _without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """docs without the rows numbered in gone, and without the numbers."""
    return docs.join(gone.select(row), row, "left_anti").drop(row)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (but for white space) the longest original, then the smallest id, then the first stays."""
    columns = docs.columns
    docs, row = _numbered(docs, "pipeline-exact")
    return _without(docs, row, exact_groups(docs, row_col=row).where(~F.col("kept"))).select(*[F.col(f"`{c}`") for c in columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near-duplicate rows the one with the smallest id, then the first stays."""
    columns = docs.columns
    docs, row = _numbered(docs, "pipeline-near")
    return _without(docs, row, near_groups(docs, row_col=row).where(~F.col("first"))).select(*[F.col(f"`{c}`") for c in columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go from all but their first place; every document stays."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", packing),
]

#: A trained classifier and a tokenizer are not SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
