"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows its predecessor kept, read back from Parquet; all but the last
return the columns of ``documents``. Stages see texts as the stage before left them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import exact_dedup, line_quality, packing, raking, similar
from tracewright.llm.queries import END_ID, VOCABULARY
from tracewright.session import scratch_path, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines of a host are cut out; documents that fail the rules or are depleted go."""
    ship_package(spark)
    return line_quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    ship_package(spark)
    return exact_dedup.keep_one(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similarity 0.8 or more over five-word shingles one stays: SimHash balls link them, exact
    similarity checks the links, and an exact join adds those that fingerprints miss."""
    ship_package(spark)
    return similar.keep_one_of_similar(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target weights."""
    ship_package(spark)
    return raking.keep_sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4096 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, VOCABULARY, END_ID)


STAGES: list[tuple[str, Stage]] = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near),
                                   ("source mixture", mixture), ("packing", packed)]

# Raking and best-fit packing are iterative; the stages are tested against plain programs instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, name.replace(" ", "-"))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
