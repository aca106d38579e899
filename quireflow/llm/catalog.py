"""The queries of the operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import hard_negatives, lloyd, pii
from quireflow.llm.context_mixing import score_texts
from quireflow.llm.language_id import language_id
from quireflow.llm.license_scan import license_scan, report
from quireflow.llm.near_duplicates import near_duplicates
from quireflow.llm.nn_descent import nearest
from quireflow.llm.packing import pack_documents
from quireflow.llm.quality_rules import quality_rules
from quireflow.llm.secret_scan import digest, secret_scan
from quireflow.llm.source_mix import ORACLE as MIX_SQL
from quireflow.llm.source_mix import mix
from quireflow.llm.weak_labels import quality_classifier
from quireflow.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_scan(read_table(spark, sf_dir, "documents")))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("source")


ORACLES["op6_source_mix"] = MIX_SQL


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(license_scan(read_table(spark, sf_dir, "documents")))


@query
def op8_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(read_table(spark, sf_dir, "documents"))


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4)


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


@query
def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))


@query
def op11_member_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.report(lloyd.compress(read_table(spark, sf_dir, "embeddings")))


ORACLES["op11_member_resident_lloyd"] = lloyd.oracle()


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = read_table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLES["op12_hard_negatives"] = hard_negatives.ORACLE


@query
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.pii_scan(read_table(spark, sf_dir, "documents")))
