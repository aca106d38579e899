"""Arrays to rows, with the array computed once.

The plain generators make the optimizer infer a filter on the array and push it, with
the array's whole expression, down to the scan, so that it is computed twice or more. The
outer ones followed by a test of their own output give the same rows without that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HERE = "__here"


def explode_structs(df: DataFrame, keep: list[str | Column], array: Column) -> DataFrame:
    """``keep`` and the fields of each struct of the array, one row per struct."""
    marked = F.transform(array, lambda s: F.struct(F.lit(1).alias(_HERE), s.alias("s")))
    rows = df.select(*keep, F.inline_outer(marked))
    return rows.where(F.col(_HERE).isNotNull()).select(
        *[c for c in rows.columns if c not in (_HERE, "s")], "s.*"
    )


def explode_values(df: DataFrame, keep: list[str | Column], array: Column, name: str) -> DataFrame:
    """``keep``, the position ``pos`` and each non-null value of the array."""
    rows = df.select(*keep, F.posexplode_outer(array).alias("pos", name))
    return rows.where(F.col(name).isNotNull())
