"""A corpus pipeline: language, near duplicates, secrets, mixture, packing.

Each stage takes all that the one before kept and hands on documents with the columns of ``documents``; the last returns
packed pieces. ``run`` writes every stage's rows to the shared folder and reads them back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quireflow.llm.common import settle
from quireflow.llm.language_id import accept
from quireflow.llm.near_duplicates import without_near_duplicates
from quireflow.llm.packing import pack_documents
from quireflow.llm.secret_scan import redact
from quireflow.llm.source_mix import mixed_documents
from quireflow.sources.tables import read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that is told with any confidence, go."""
    return accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays."""
    return without_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced by a mark."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, once for each copy."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and the sequences they are packed in."""
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("packing", packing),
]

#: Kernels, signatures and tokenizers are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = settle(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
