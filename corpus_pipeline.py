"""A corpus pipeline of five stages: quality, exact dedup, near dedup, source mix, packing.

Every stage but the last returns the columns of documents; the last returns the packed pieces. Each works on all that
its predecessor kept. Nulls in any column, empty texts, repeated ids and rows, and empty tables pass through every stage
as its operator's docstring says; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import exact_dedup, near_dedup, packing, quality, source_mix
from quadrille.llm.common import documents, materialize, scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects; it learns from all labels of documents that are here. Without labels all stay.

    Null and empty texts are scored like any other; equal texts stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accept(docs, quality.train(docs, labels))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, one with the largest doc_id. Null is the empty text."""
    return exact_dedup.deduplicate(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document with the smallest doc_id stays; texts without words all stay."""
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it: not at all, once or twice. Empty texts aren't taken."""
    return source_mix.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences. A repeated row is packed as often as it is there."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Training, sketches and tokens can't be expressed in SQL; the tests hold every stage, and the run, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage writes for itself goes with it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = materialize(stage(spark, docs, sf_dir), name)
            keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
