"""Last-writer-wins de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep, per key, the row that is greatest by ``order``.

    Written as one ``max`` over a struct rather than a ranking window: the maximum
    is taken per task before the shuffle, so a key with a third of all rows sends
    one row per task. Ties fall to the remaining columns, so the survivor does not
    depend on the order in which rows arrive.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    row = F.struct(*order, *rest)
    best = df.groupBy(*key).agg(F.max(row).alias("row"))
    return best.select(*[F.col(c) if c in key else F.col(f"row.`{c}`").alias(c) for c in df.columns])
