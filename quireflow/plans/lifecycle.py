"""Objects of a whole run: upload what is new, sync the tables, delete what is gone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators import objects
from quireflow.session import settle
from quireflow.specs import TableSpec


def stored_objects(
    spark: SparkSession, tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]
) -> DataFrame:
    """Objects with a store as (hash, store, bucket, namespace, key, path, uri), one row per hash."""
    return _one_per_hash(located_objects(spark, tables, specs))


def located_objects(
    spark: SparkSession, tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]
) -> DataFrame:
    return objects.route(objects.with_location(objects.inventory(spark, tables, specs)))


def _one_per_hash(found: DataFrame) -> DataFrame:
    return objects.last_by_hash(found, ["seq", "uri"]).drop("seq")


def object_actions(
    spark: SparkSession,
    old: Mapping[str, DataFrame],
    new: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec],
    force: bool = False,
) -> DataFrame:
    """(action, store, uri, hash) with action in upload, skip, delete.

    Uploads come before and deletions after the table sync, so a reader never sees
    a row whose object is missing. What is stored after a sync are the incoming keys with the incoming data,
    so deletions are computed from the incoming side. Each side's objects are listed and settled once.
    """
    before = settle(stored_objects(spark, old, specs), "objects-before")
    incoming = settle(located_objects(spark, new, specs), "objects-incoming")
    uploads = objects.partition_uploads(incoming, before, force)
    gone = objects.disappeared(before, _one_per_hash(incoming), incoming)
    action = F.when(F.col("skipped"), "skip").otherwise("upload")
    return uploads.select(action.alias("action"), "store", "uri", "hash").unionByName(
        gone.select(F.lit("delete").alias("action"), "store", "uri", "hash")
    )
