"""A training corpus from raw documents: five stages over the operators of ``webquarry.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and
returns what is left; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webquarry.llm import common, linededup, mixing, neardup, packing, quality
from webquarry.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, common.table(ship(spark), sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go, and documents of which nothing is left."""
    ship(spark)
    return linededup.without_duplicate_blocks(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more over five-word shingles, the smallest id stays."""
    ship(spark)
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as the sources' targets ask."""
    ship(spark)
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: no bin holds two copies of a text."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Learned, aligned and randomised stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written to the shared folder and read again."""
    docs = common.table(ship(spark), sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, f"stage{i + 1}")
    return docs
