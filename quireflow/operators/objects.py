"""Object inventory and lifecycle: what to upload, what to skip, what to delete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireflow.functions.refs import pointer_uri
from quireflow.operators.joins import absent_by_key, flag_known
from quireflow.session import settle
from quireflow.specs import POINTER_TYPE, TableSpec

STORES = ("r2", "kv", "asset")
LOCATION = ["type", "bucket", "namespace", "key", "path"]


def inventory(
    spark: SparkSession, tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]
) -> DataFrame:
    """(seq, hash, pointer) of every object any table refers to.

    ``seq`` numbers the (table, column) pairs in schema order. Rows without an object
    are left out; a schema without object columns gives an empty result.
    """
    parts = []
    for name, spec in specs.items():
        for column in spec.object_cols:
            ref = F.col(f"`{column}`")
            parts.append(
                tables[name]
                .where(ref["hash"].isNotNull())
                .select(
                    F.lit(len(parts)).alias("seq"),
                    ref["hash"].alias("hash"),
                    ref["pointer"].alias("pointer"),
                )
            )
    if not parts:
        schema = f"seq int, hash string, pointer {POINTER_TYPE.simpleString()}"
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def last_by_hash(objects: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per hash, the last by ``order``. Copies collapse before the shuffle."""
    rest = [c for c in objects.columns if c not in ("hash", *order)]
    best = objects.groupBy("hash").agg(F.max(F.struct(*order, *rest)).alias("o"))
    return best.select("hash", *[F.col(f"o.{c}").alias(c) for c in (*order, *rest)])


def to_upload(uploads: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Uploads whose hash is not stored yet; all of them when forced.

    Pass routed uploads without their payload. The hash of an object with a store covers its
    location, so hashes are unique here, copies of a content included; the join moves
    hashes only, and the payload is read for the survivors alone.
    """
    if force:
        return uploads
    return absent_by_key(uploads, stored, ["hash"])


def partition_uploads(uploads: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """All (routed) uploads with a ``skipped`` flag."""
    if force:
        return uploads.withColumn("skipped", F.lit(False))
    return flag_known(uploads, stored, ["hash"], "skipped")


def disappeared(before: DataFrame, after: DataFrame, written: DataFrame) -> DataFrame:
    """Stored objects no row refers to any more.

    A pointer written in this run is kept even if its old hash is gone: the key now
    holds the new content. Pass routed objects: inline ones have no place to be deleted
    from, and their hashes are not unique.
    """
    return absent_by_key(absent_by_key(before, after, ["hash"]), written, ["uri"])


def with_location(objects: DataFrame, pointer: str = "pointer") -> DataFrame:
    """Replace the pointer struct by its location columns and its URI text."""
    p = F.col(pointer)
    return objects.select(
        *[c for c in objects.columns if c != pointer],
        *[p[c].alias(c) for c in LOCATION],
        pointer_uri(p).alias("uri"),
    )


def route(objects: DataFrame) -> DataFrame:
    """Objects that have a store, with its name in ``store``.

    Inline objects live in their row and need none. Write the result with
    ``partitionBy("store")``, or filter on it per sink.
    """
    return objects.where(F.col("type").isin(*STORES)).withColumnRenamed("type", "store")


def overlay(stored: DataFrame, puts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Object store after the puts: the last write of each key wins.

    The greatest (age, row) per key is taken on the map side first, so a key that is
    put very often sends one row per task.
    """
    rest = [c for c in stored.columns if c not in key]
    aged = stored.withColumn("__age", F.lit(0)).unionByName(puts.withColumn("__age", F.lit(1)))
    best = aged.groupBy(*key).agg(F.max(F.struct("__age", *rest)).alias("o"))
    return best.select(*key, *[F.col(f"o.{c}").alias(c) for c in rest])


def delete(stored: DataFrame, deletions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Object store after deleting the listed keys, and only those."""
    return absent_by_key(stored, deletions, key)


#: Optional columns of a pair: when it goes (a time, or seconds from now), and what is kept beside it.
KV_OPTIONS = ("expiration", "expiration_ttl", "metadata")


def kv_batches(pairs: DataFrame, target: int = 10_000, max_bytes: int = 100_000_000) -> DataFrame:
    """(namespace, batch, pairs): bulk puts of at most ``target`` pairs and ``max_bytes`` of keys, values and metadata.

    ``pairs`` holds namespace, key (unique within it), value, base64 and any of KV_OPTIONS; a null namespace is one as well. Keys and sizes are
    sorted into ranges; sums within a range and of the ranges before it tell where in its namespace each pair
    starts, and so its batch. A namespace with most of the pairs is many ranges and many batches, and every pair is in one.
    Of what is left half the bytes are filled, so that the last pair of a batch fits; a pair that is larger than that is a batch of its own,
    with a negative number. Numbers may have gaps.
    """
    options = [c for c in KV_OPTIONS if c in pairs.columns]
    texts = ["key", "value", *[c for c in options if c == "metadata"]]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0)).cast("bigint")
    sorted_ = pairs.select("namespace", "key", size.alias("size")).repartitionByRange("namespace", "key")
    # Settled, since ranges are drawn from a sample and would not come out the same twice.
    ranged = settle(sorted_.withColumn("range", F.spark_partition_id()), "kv-ranges")
    room = max(1, max_bytes // 2)
    small = F.col("size") <= room
    ahead = Window.partitionBy("range", "namespace").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"bytes": F.sum(F.when(small, F.col("size"))), "n": F.count(F.when(small, 1)), "large": F.count(F.when(~small, 1))}
    zero = lambda c: F.coalesce(c, F.lit(0))
    started = ranged.select("*", *[zero(v.over(ahead)).alias(f"own_{k}") for k, v in sums.items()])
    earlier = Window.partitionBy("namespace").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range", "namespace").agg(*[zero(v).alias(k) for k, v in sums.items()])
    totals = totals.select(F.col("range").alias("r"), F.col("namespace").alias("ns"), *[zero(F.sum(k).over(earlier)).alias(k) for k in sums])
    placed = started.join(totals, (F.col("range") == F.col("r")) & F.col("namespace").eqNullSafe(F.col("ns")))
    start = {k: F.col(k) + F.col(f"own_{k}") for k in sums}
    # Both parts only ever rise along the order, so their sum changes whenever one of them does.
    batch = F.when(small, F.floor(start["bytes"] / room) + F.floor(start["n"] / target)).otherwise(-1 - start["large"])
    named = placed.select(F.col("namespace").alias("of"), F.col("key").alias("k"), batch.cast("bigint").alias("batch"))
    joined = pairs.join(named, (F.col("key") == F.col("k")) & F.col("namespace").eqNullSafe(F.col("of")))
    return joined.groupBy("namespace", "batch").agg(F.array_sort(F.collect_list(F.struct("key", "value", "base64", *options))).alias("pairs"))


def delete_batches(keys: DataFrame, target: int = 10_000) -> DataFrame:
    """(namespace, batch, keys): bulk deletes, batched like the puts."""
    blank = keys.select("namespace", "key", F.lit("").alias("value"), F.lit(False).alias("base64"))
    return kv_batches(blank, target).select(
        "namespace", "batch", F.col("pairs.key").alias("keys")
    )
