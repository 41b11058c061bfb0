"""The corpus pipeline: five operators in a row, each on all that its predecessor kept.

Defined cases of all stages: rows with nulls in any column, repeated rows, empty and very long texts pass through like others; extra columns are kept, whatever
their names; an empty table gives an empty result with its columns. Without labels of both kinds the quality stage keeps every document; without
benchmark items nothing is contaminated. A document without an id is never a near-duplicate of another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inventra.llm import decontaminate, line_dedup, mixing, quality_compress, simhash_dedup
from inventra.llm.common import staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good."""
    return quality_compress.keep(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line found in 10 documents or more, only the first one stays, so one copy of each document remains whole."""
    return line_dedup.clean(docs, keep="first")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return simhash_dedup.dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight; a document is repeated as often as it is taken."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("sources", sources)]

#: A trained classifier and connected components are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
