"""From raw documents to packed sequences: five stages, each a table for the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gavel.llm.common import stored, table, tuned, without_dropped
from gavel.llm.exact_dedup import exact_dedup
from gavel.llm.mixing import mixed_documents
from gavel.llm.near_dedup import near_dedup
from gavel.llm.packing import added_tokens, pack
from gavel.llm.quality import good_documents, trusted_ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the labelled good ones are the trusted target."""
    tuned(spark)
    return good_documents(docs, trusted_ids(table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts: the one with the smallest id."""
    tuned(spark)
    return without_dropped(docs, lambda rows, row: exact_dedup(rows, row_col=row), "exact")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    tuned(spark)
    return without_dropped(docs, lambda rows, row: near_dedup(rows, row_col=row), "near")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source weight, repeats as rows of their own."""
    tuned(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows of the mix, their ids and their places in sequences of 2048 tokens."""
    tuned(spark)
    return pack(
        docs,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        with_ids=True,
        added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")),
    )


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("minhash near-dedup", near),
    ("source mixing", mixture),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    tuned(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Hashing of n-grams and tokens is beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
