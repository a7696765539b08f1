"""The corpus pipeline: documents in, deduplicated and decontaminated token ids out.

Each stage gets what the stage before it kept, as a table read back from Parquet, and decides on all
of it. Stages before the last return the columns of ``documents``, the last one has token ids in
place of the text. The stages learn from the rows that they get; labels and benchmark items come
from the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import bpe, decontaminate, language, quality, simhash
from maskwright.llm.common import materialize, table
from maskwright.session import ship


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier doesn't reject."""
    ship(spark)
    return quality.quality_stage(spark, docs, sf_dir)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what has a language."""
    ship(spark)
    return language.language_stage(spark, docs, sf_dir)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    ship(spark)
    return simhash.dedup_stage(spark, docs, sf_dir)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what holds no benchmark passage."""
    ship(spark)
    return decontaminate.clean_stage(spark, docs, sf_dir)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    ship(spark)
    return bpe.encode_stage(spark, docs, sf_dir)


STAGES = [
    ("quality", classify_quality),
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", encode_tokens),
]

#: Trained models and fingerprints can't be said in SQL; a test holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
