"""Validation of whole record sets: dead letters, warnings, typed nested frames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions import typed
from quireflow.operators.rows import explode_structs, explode_values
from quireflow.specs import CollectionSpec

BOUND, ERRORS = "__bound", "errors"


def with_errors(records: DataFrame, collection: CollectionSpec, record: str = "record") -> DataFrame:
    """Add ``errors``, the array of everything wrong with the document. Local to the row."""
    specs = collection.tables()
    root = specs[collection.table]
    unreadable = F.array(
        F.struct(
            F.lit("?").alias("id"),
            F.lit("").alias("field"),
            F.lit("UnreadableDocument").alias("code"),
            F.lit("object").alias("expected"),
            F.lit(None).cast("string").alias("got"),
        )
    )
    found = F.when(F.col(BOUND).isNull(), unreadable).otherwise(
        typed.record_errors(F.col(BOUND), root, specs)
    )
    bound = F.when(typed.is_object(F.col(record)), typed.bind(F.col(record), root, specs))
    return records.withColumn(BOUND, bound).drop(record).withColumn(ERRORS, found)


def dead_letters(checked: DataFrame, entry: str = "source_entry") -> DataFrame:
    """(source_entry, id, field, code, expected, got), one row per error."""
    return explode_structs(checked, [F.col(entry).alias("source_entry")], F.col(ERRORS))


def accepted(
    checked: DataFrame, collection: CollectionSpec, mode: str = "deadletter"
) -> DataFrame:
    """Typed nested frame of the documents without errors.

    ``deadletter`` leaves bad documents out, whole; ``failfast`` fails the job on the
    first one, as a batch compiler does.
    """
    if mode not in ("deadletter", "failfast"):
        raise ValueError(f"unknown mode {mode!r}")
    row = typed_struct(collection)
    good = F.when(F.size(ERRORS) == 0, F.array(row))
    if mode == "failfast":
        message = F.concat(F.lit("bad record: "), F.to_json(F.col(ERRORS)))
        good = good.otherwise(F.raise_error(message).cast(good_type(checked, row)))
    keep = [c for c in checked.columns if c.startswith("__") and c != BOUND]
    return explode_structs(checked, list(keep), good)


def typed_struct(collection: CollectionSpec) -> Column:
    """The declared, typed fields of a checked document, records nested."""
    specs = collection.tables()
    return F.struct(*typed.typed_record(F.col(BOUND), specs[collection.table], specs))


def good_type(checked: DataFrame, row: Column):
    return checked.select(F.array(row).alias("a")).schema["a"].dataType


def warnings(df: DataFrame, entry: Column, rules: Mapping[str, Column]) -> DataFrame:
    """(entry, seq, message) for every rule a row meets. Warnings never reject a row."""
    found = F.array_compact(
        F.array(*[F.when(condition, F.lit(message)) for message, condition in rules.items()])
    )
    return explode_values(df, [entry.alias("entry")], found, "message").withColumnRenamed("pos", "seq")
