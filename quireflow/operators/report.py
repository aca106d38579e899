"""Run reports from the run's log tables: entries, uploads, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DONE, FAILED = "done", "failed"
UPLOADED, SKIPPED = "uploaded", "skipped"


def run_report(entries: DataFrame, uploads: DataFrame) -> DataFrame:
    """One row: total, successful, failed entries, and uploads written or skipped."""
    status = F.col("status")
    of_entries = entries.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == DONE).alias("successful"),
        F.count_if(status == FAILED).alias("failed"),
        F.lit(0).cast("bigint").alias("uploads"),
    )
    zero = F.lit(0).cast("bigint")
    of_uploads = uploads.agg(
        zero.alias("total"),
        zero.alias("successful"),
        zero.alias("failed"),
        F.count_if(status.isin(UPLOADED, SKIPPED)).alias("uploads"),
    )
    names = ("total", "successful", "failed", "uploads")
    return of_entries.unionByName(of_uploads).agg(*[F.sum(n).alias(n) for n in names])


def entry_report(entries: DataFrame, uploads: DataFrame, warnings: DataFrame) -> DataFrame:
    """(entry, status, n_warnings, n_uploaded, n_skipped), ordered by entry.

    The three logs are stacked and counted in one pass, so an entry with very many uploads or
    warnings costs one row per task.
    """
    status = F.col("status")
    none = F.lit(None).cast("string")
    stacked = (
        entries.select("entry", status.alias("status"), none.alias("what"))
        .unionByName(uploads.select("entry", none.alias("status"), status.alias("what")))
        .unionByName(warnings.select("entry", none.alias("status"), F.lit("warning").alias("what")))
    )
    what = F.col("what")
    return (
        stacked.groupBy("entry")
        .agg(
            F.max("status").alias("status"),
            F.count_if(what == "warning").alias("n_warnings"),
            F.count_if(what == UPLOADED).alias("n_uploaded"),
            F.count_if(what == SKIPPED).alias("n_skipped"),
        )
        .orderBy("entry")
    )


def report_lines(entries: DataFrame, uploads: DataFrame, warnings: DataFrame) -> DataFrame:
    """(entry, part, line): the report as lines, the entry first, then its warnings and uploads.

    Rows are sorted, never collected, so an entry may have any number of them.
    """
    lines = (
        entries.select("entry", F.lit(0).alias("part"), F.col("status").alias("line"))
        .unionByName(warnings.select("entry", F.lit(1).alias("part"), F.col("message").alias("line")))
        .unionByName(
            uploads.select(
                "entry", F.lit(2).alias("part"), F.concat_ws(" ", "status", "uri").alias("line")
            )
        )
    )
    return lines.orderBy("entry", "part", "line")
