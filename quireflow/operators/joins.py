"""Key joins that stay exact when one key holds much of the left side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KNOWN = "__known"


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def distinct_keys(df: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Distinct key tuples, renamed by position. Copies collapse before the shuffle."""
    names = names or columns
    return df.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]).distinct()


def anti_by_key(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose (compound) key is not in ``right``.

    A ``left_anti`` on all key columns, so a null on the right cannot empty the
    result, as it would with ``NOT IN``.
    """
    return left.join(right.select(*key), list(key), "left_anti")


def flag_known(left: DataFrame, right: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    """All rows of ``left``, with a boolean that tells whether ``right`` has their key."""
    known = right.select(*key).distinct().withColumn(flag, F.lit(True))
    return left.join(known, list(key), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def absent_by_key(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """``anti_by_key`` for a ``left`` made of many unions.

    The optimizer pushes an anti join into every branch of a union and so plans
    ``right`` once per branch; this form joins once, above the union.
    """
    return flag_known(left, right, key, _KNOWN).where(~F.col(_KNOWN)).drop(_KNOWN)


def semi_by_key(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    return left.join(right.select(*key), list(key), "left_semi")


def anti_by_row(left: DataFrame, right: DataFrame, key: Sequence[str], data: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with no identical row in ``right`` (nulls equal nulls).

    Keys are never null, so they join by plain equality and carry the shuffle;
    only the data columns are compared null-safely.
    """
    l, r = left.alias("l"), right.select(*key, *data).alias("r")
    same = [F.col(f"l.`{c}`") == F.col(f"r.`{c}`") for c in key]
    same += [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in data]
    return l.join(r, all_of(same), "left_anti")


def key_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join of rows with a look-up table whose keys are unique.

    A key with much of the left side is split at run time: adaptive execution cuts the
    left partitions of inner, left, semi and anti joins and reads the right one for each cut.
    Both inputs are planned once, so joins can be chained.
    """
    return left.join(right, list(on), how)
