"""Shortest length at which the digests of a group stay distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.hashing import common_prefix_length
from quireflow.operators.joins import key_join

# Prefix lengths at which strings are compared, longest first.
LEVELS = (8, 4, 0)


def shortest_unique_length(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, short_len): longest prefix two values of the group share, plus one.

    Two values share at least ``p`` characters only if they agree on the first ``p``. So
    sorted neighbours are compared inside buckets of equal 8-character prefix; the
    distinct 8-character prefixes, inside buckets of equal 4; the distinct
    4-character prefixes, inside the group. The maximum over the levels is exact for any
    strings. Hex digests put at most 65,536 values into a bucket of the two
    lower levels and spread a group of any size over 16^8 buckets on the top one, so no
    window ever holds a whole group. Copies of one value are counted first, on the map
    side, and never reach a window: they share all of it.
    """
    counted = df.groupBy(F.col(group), F.col(value).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.select(group, "s")
    found = counted.where(F.col("n") > 1).select(group, F.length("s").alias("shared"))
    upper = None
    for length in LEVELS:
        level = rows if upper is None else rows.select(
            group, F.substring("s", 1, upper).alias("s")
        ).distinct()
        found = found.unionByName(_neighbours(level, group, length))
        upper = length
    return found.groupBy(group).agg((F.max("shared") + 1).alias("short_len"))


def _neighbours(rows: DataFrame, group: str, length: int) -> DataFrame:
    bucket = F.substring("s", 1, length) if length else F.lit("")
    window = Window.partitionBy(group, "bucket").orderBy("s")
    before = F.lag("s").over(window)
    shared: Column = F.when(F.col("before").isNull(), 0).otherwise(
        common_prefix_length(F.col("before"), F.col("s"))
    )
    return (
        rows.withColumn("bucket", bucket)
        .withColumn("before", before)
        .select(group, shared.alias("shared"))
    )


def with_short_digest(df: DataFrame, group: str, value: str) -> DataFrame:
    """Add ``short_len`` and ``short``, the value cut to it."""
    lengths = shortest_unique_length(df, group, value)
    joined = key_join(df, lengths, [group], "inner")
    return joined.withColumn("short", F.substring(F.col(value), F.lit(1), F.col("short_len")))
