"""A corpus pipeline of five stages; each is written as Parquet and read again by the next.

Part of the subpackage ``tonaris.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonaris.llm import decontaminate, lines, mixing, quality, simhash
from tonaris.llm.common import materialise, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; a rejected document goes."""
    return quality.accept(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that 10 or more of them share."""
    return lines.line_dedup(docs, min_docs=10)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return simhash.near_dedup(docs, width=5, similarity=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: how many words it takes of each document, and when."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("simhash", simhash_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs


#: A learned classifier and an approximate search stand in the way of SQL; tests hold run() against plain versions.
ORACLE_SQL = None
