"""Quality rules, exact dedup, near duplicates, repeated passages, packing: a corpus on its way to training.

In each stage a null text is an empty one, a row that repeats another stays or
goes with it, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphband.llm import exact_dedup, ngram_join, packing, quality_rules, substring_dedup
from graphband.llm.queries import tokenizer
from graphband.session import discard, materialise, table

#: Bytes of words' ids that a worker keeps while it serves other stages.
TABLE = 16 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those without ten words among them."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand anywhere else are cut out of texts; all rows stay."""
    return substring_dedup.without_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a training window."""
    return packing.pack(docs, tokenizer(), table=TABLE)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near duplicates", near),
    ("substring dedup", passages),
    ("packing", pack),
]

#: SQL cannot tokenise; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = before = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
