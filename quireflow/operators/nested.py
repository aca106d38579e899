"""Nested records to relational tables, and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.functions.hashing import row_hash
from quireflow.operators.joins import key_join
from quireflow.specs import CollectionSpec, TableSpec

POS = "__pos"
DOC_HASH = "__doc_hash"
SOURCE = "__source"
PASSED_ON = (DOC_HASH, SOURCE)


def explode_children(
    parent: DataFrame, parent_key: Sequence[str], records: str, child: TableSpec
) -> DataFrame:
    """Child rows with the parent's whole key, renamed by position.

    Elements are structs, or bare strings if the child has no field but its id. Exploding is
    local to the row, so no shuffle, however many children a parent has. ``__pos``
    keeps the element's place.
    """
    if len(parent_key) != len(child.inherit_ids):
        raise ValueError(f"{child.name}: inherit_ids do not match the key of {child.parent}")
    keys = [F.col(k).alias(i) for k, i in zip(parent_key, child.inherit_ids, strict=True)]
    passing = [c for c in PASSED_ON if c in parent.columns]
    rows = parent.select(*keys, *passing, F.posexplode_outer(records).alias(POS, "__r"))
    rows = rows.where(F.col(POS).isNotNull())
    element = rows.schema["__r"].dataType
    if not isinstance(element, T.StructType):
        if not child.id_only:
            raise TypeError(f"{child.name}: bare values need an id-only table")
        return rows.select(
            *child.inherit_ids, F.col("__r").alias(child.id_name), POS, *passing
        )
    return rows.select(*child.inherit_ids, "__r.*", POS, *passing)


def frames(nested: DataFrame, collection: CollectionSpec) -> dict[str, DataFrame]:
    """Rows of every table with all their fields, nested ones included, parents first.

    A loop over the declared tables only: each frame is its own lazy chain of projections and
    ``posexplode`` over the scan. Tables of markdown images are not made from records
    and are left out.
    """
    specs = collection.tables()
    out: dict[str, DataFrame] = {}
    for name, spec in specs.items():
        if spec.parent is None:
            out[name] = nested
            continue
        above, field = out[spec.parent], spec.path[-1]
        if field in above.columns and specs[spec.parent].field(field).kind == "records":
            out[name] = explode_children(above, spec.parent_key, field, spec)
    return out


def flatten(nested: DataFrame, collection: CollectionSpec) -> dict[str, DataFrame]:
    """All tables of a collection from one frame of nested records, parents first.

    If the frame carries ``__doc_hash``, tables that declare a hash column get their
    row hash.
    """
    specs = collection.tables()
    return {
        name: _stored_columns(frame, specs[name])
        for name, frame in frames(nested, collection).items()
    }


def _stored_columns(frame: DataFrame, spec: TableSpec) -> DataFrame:
    columns: list[Column] = []
    for name in spec.columns:
        if name == spec.hash_name and DOC_HASH in frame.columns:
            columns.append(row_hash(spec, F.col(DOC_HASH)).alias(name))
        elif name in frame.columns:
            columns.append(F.col(f"`{name}`"))
    if POS in frame.columns:
        columns.append(F.col(POS))
    return frame.select(*columns)


def merge(batches: Sequence[Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Per-batch tables to whole tables."""
    names = dict.fromkeys(name for batch in batches for name in batch)
    return {
        name: reduce(DataFrame.unionByName, [b[name] for b in batches if name in b])
        for name in names
    }


def renest(
    parent: DataFrame,
    child: DataFrame,
    parent_key: Sequence[str],
    child_spec: TableSpec,
    field: str,
    target: int = 10_000,
) -> DataFrame:
    """Parent rows with their child rows embedded as an array, in order.

    A parent with more than about ``target`` children comes out in ``parts`` rows, each
    with the parent's fields and one ``part`` of the children, so no group grows without
    bound and nothing is left out. A parent without children has one part and a
    null array.
    """
    inherit = list(child_spec.inherit_ids)
    parts = child.groupBy(*inherit).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(target)).alias("parts")
    )
    bucket = F.conv(
        F.substring(F.sha2(F.col(child_spec.id_name).cast("string"), 256), 1, 8), 16, 10
    ).cast("bigint")
    body = [c for c in child.columns if c not in (*inherit, POS)]
    order = [POS] if POS in child.columns else [child_spec.id_name]
    groups = (
        key_join(child, parts, inherit, "inner")
        .withColumn("part", F.pmod(bucket, F.col("parts")))
        .groupBy(*inherit, "part", "parts")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(*[F.col(c).alias(f"__o_{c}") for c in order], *body))
            ).alias("__rows")
        )
        .select(
            *[F.col(i).alias(k) for i, k in zip(inherit, parent_key, strict=True)],
            "part",
            "parts",
            F.transform("__rows", lambda r: F.struct(*[r[c].alias(c) for c in body])).alias(field),
        )
    )
    joined = parent.join(groups, list(parent_key), "left")
    return joined.withColumn("part", F.coalesce("part", F.lit(0))).withColumn(
        "parts", F.coalesce("parts", F.lit(1))
    )
