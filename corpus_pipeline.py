"""A corpus pipeline of five stages, each written as Parquet and read again for the next one.

STAGES lists (name, function); a function takes (spark, docs, sf_dir). All but the last return the
columns of documents. This module needs veilspark.llm and counts as part of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import decontam, exact, neardup, packing, scratch, toxicity
from veilspark.llm.queries import byte_bpe
from veilspark.session import ship_package, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a noisy-or score below one half; trained on the labelled ones of the same tables."""
    ship_package(spark)
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the row with the smallest doc_id."""
    ship_package(spark)
    return neardup.keep_one(docs, 75)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 ids."""
    ship_package(spark)
    return packing.pack_documents(docs, byte_bpe(), capacity=2048, end_id=1, digest=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The trained stage and the packing can't be written in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents."""
    docs = table(spark, sf_dir, "documents")
    base = scratch.folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{base}/{i}-{name}")
        if i:
            scratch.drop(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
