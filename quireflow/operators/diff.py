"""Snapshot diff: change-detecting upsert, cleanup, cascade and ancestor touch.

``old`` is the stored state of a table, ``new`` the incoming one. Both are immutable
inputs, so the order of the steps is a data dependency, never a side effect. Keys
are unique on both sides (``dedup.last_wins`` sees to that), hence a key join here
has no hot key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.operators.joins import any_of, anti_by_key, anti_by_row, distinct_keys, key_join, semi_by_key
from quireflow.specs import TableSpec, children_of

INSERT, UPDATE, UNCHANGED, DELETE, TOUCH = "insert", "update", "unchanged", "delete", "touch"
TOUCHED = "__touched"


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)


def _data(spec: TableSpec) -> list[str]:
    return spec.data_cols


def side_by_side(
    old: DataFrame,
    new: DataFrame,
    spec: TableSpec,
    carry: Sequence[str] = (),
    how: str = "full_outer",
) -> DataFrame:
    """Both states side by side, one row per key of either."""
    return packed(old, spec, "o", carry).join(packed(new, spec, "n"), spec.pk, how)


def packed(rows: DataFrame, spec: TableSpec, name: str, carry: Sequence[str] = ()) -> DataFrame:
    """Key columns and one struct of the data columns, which is null where a join finds no row."""
    return rows.select(*spec.pk, F.struct(F.lit(1).alias("here"), *_data(spec), *carry).alias(name))


def _stored() -> Column:
    return F.col("o").isNotNull()


def _incoming() -> Column:
    return F.col("n").isNotNull()


def _differs(spec: TableSpec) -> Column:
    return any_of([~F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")) for c in _data(spec)])


def op_of(spec: TableSpec) -> Column:
    return (
        F.when(~_stored(), F.lit(INSERT))
        .when(~_incoming(), F.lit(DELETE))
        .when(_differs(spec), F.lit(UPDATE))
        .otherwise(F.lit(UNCHANGED))
    )


def change_feed(old: DataFrame, new: DataFrame, spec: TableSpec) -> DataFrame:
    """(key…, op) with op in insert, update, unchanged, delete."""
    return side_by_side(old, new, spec).select(*spec.pk, op_of(spec).alias("op"))


def dirty_keys(old: DataFrame, new: DataFrame, spec: TableSpec) -> DataFrame:
    """Keys of rows that are new, changed or gone."""
    return change_feed(old, new, spec).where(F.col("op") != UNCHANGED).select(*spec.pk)


def incoming_changes(old: DataFrame, new: DataFrame, spec: TableSpec) -> DataFrame:
    """Incoming rows with no identical stored row; timestamps do not count."""
    return anti_by_row(new, old, spec.pk, _data(spec))


def removed_rows(old: DataFrame, new: DataFrame, spec: TableSpec) -> DataFrame:
    """Stored rows whose key no longer comes in."""
    return anti_by_key(old, new, spec.pk)


def _stamps(spec: TableSpec, old: DataFrame) -> list[str]:
    return [c for c in (spec.created_at, spec.updated_at) if c and c in old.columns]


def upsert(old: DataFrame, new: DataFrame, spec: TableSpec, run_ts: str) -> DataFrame:
    """State after the upsert: rows that did not come in are still there.

    A matched row is rewritten only if a data column differs. ``created_at`` is set
    once; ``updated_at`` moves on insert and on a real change. A table with no data
    column takes new keys and leaves the stored rows alone.
    """
    if not _data(spec):
        return insert_only(old, new, spec, run_ts)
    return _settle(side_by_side(old, new, spec, _stamps(spec, old)), spec, old, run_ts)


def _settle(joined: DataFrame, spec: TableSpec, old: DataFrame, run_ts: str) -> DataFrame:
    op, now = F.col("__op"), run_timestamp(run_ts)
    fresh = op.isin(INSERT, UPDATE)
    out: list[Column] = []
    for name in old.columns:
        if name in spec.pk:
            out.append(F.col(name))
        elif name == spec.created_at:
            out.append(F.when(op == INSERT, now).otherwise(F.col(f"o.`{name}`")).alias(name))
        elif name == spec.updated_at:
            out.append(F.when(fresh, now).otherwise(F.col(f"o.`{name}`")).alias(name))
        elif name in _data(spec):
            out.append(
                F.when(fresh, F.col(f"n.`{name}`")).otherwise(F.col(f"o.`{name}`")).alias(name)
            )
    return joined.withColumn("__op", op_of(spec)).select(*out)


def insert_only(old: DataFrame, new: DataFrame, spec: TableSpec, run_ts: str) -> DataFrame:
    """Insert or do nothing, for tables whose only field is the id."""
    added = anti_by_key(new.select(*spec.pk), old, spec.pk)
    stamps = _stamps(spec, old)
    added = added.select("*", *[run_timestamp(run_ts).alias(c) for c in stamps])
    return old.select(*spec.pk, *stamps).unionByName(added)


def synced(old: DataFrame, new: DataFrame, spec: TableSpec, run_ts: str) -> DataFrame:
    """``cleanup(upsert(old, new), new)`` in one left join from the incoming side.

    What survives a whole run are exactly the incoming keys, so stored rows that
    vanish need not pass through a full outer join first.
    """
    stamps = _stamps(spec, old)
    if not _data(spec):
        kept = new.select(*spec.pk).join(old.select(*spec.pk, *stamps), spec.pk, "left")
        return kept.select(*spec.pk, *[F.coalesce(F.col(c), run_timestamp(run_ts)).alias(c) for c in stamps])
    joined = side_by_side(old, new, spec, stamps, how="right_outer")
    return _settle(joined, spec, old, run_ts)


def cleanup(state: DataFrame, new: DataFrame | None, spec: TableSpec) -> DataFrame:
    """Drop rows whose whole key did not come in. No incoming table drops them all."""
    if new is None:
        return empty_like(state)
    return semi_by_key(state, new, spec.pk)


def cascade(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]) -> dict[str, DataFrame]:
    """Drop descendants of vanished parents, from the root down.

    A parent may own any share of a child table, so the child side is balanced; the
    parent side is keys only.
    """
    out: dict[str, DataFrame] = {}
    for name, spec in specs.items():
        table = tables[name]
        if spec.parent is not None:
            parent = distinct_keys(out[spec.parent], spec.parent_key, spec.inherit_ids)
            table = key_join(table, parent, spec.inherit_ids, "left_semi")
        out[name] = table
    return out


def touched_keys(
    dirty: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]
) -> dict[str, DataFrame]:
    """Per table, keys of the rows with a dirty descendant at any depth.

    Works upwards one level at a time: what a child passes on is its own dirty keys
    plus the keys touched below it, cut to the parent's part of the key. Each level
    is a distinct over key tuples, so a parent with many dirty children costs one
    row per task. Pass settled keys, as every level above reads them again.
    """
    out: dict[str, DataFrame] = {}
    for name, spec in reversed(list(specs.items())):
        parts = []
        for child in children_of(specs, name):
            below = [dirty[child.name].select(*child.inherit_ids)]
            if child.name in out:
                below.append(out[child.name].select(*child.inherit_ids))
            parts += [
                df.select(*[F.col(c).alias(k) for c, k in zip(child.inherit_ids, spec.pk, strict=True)])
                for df in below
            ]
        if parts:
            out[name] = reduce(DataFrame.unionByName, parts).distinct()
    return out


def flag_touched(old: DataFrame, touched: DataFrame, spec: TableSpec) -> DataFrame:
    return old.join(touched.withColumn(TOUCHED, F.lit(True)), spec.pk, "left")


def touch(old: DataFrame, touched: DataFrame | None, spec: TableSpec, run_ts: str) -> DataFrame:
    """Set ``updated_at`` on stored rows that have a dirty descendant."""
    if touched is None or spec.updated_at is None:
        return old
    moved = F.when(F.col(TOUCHED), run_timestamp(run_ts)).otherwise(F.col(spec.updated_at))
    flagged = flag_touched(old, touched, spec).withColumn(spec.updated_at, moved)
    return flagged.select(*old.columns)


def key_prefix_semi(ancestor: DataFrame, spec: TableSpec, descendant: DataFrame, below: TableSpec) -> DataFrame:
    """Ancestor rows with at least one row in ``descendant``, matched on the key prefix."""
    prefix = below.inherit_ids[: len(spec.pk)]
    return semi_by_key(ancestor, distinct_keys(descendant, prefix, spec.pk), spec.pk)


def run_timestamp(value: str) -> Column:
    """One instant for the whole run; every stamp written by it is equal."""
    return F.lit(value).cast(T.TimestampType())


def render_timestamp(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def key_text(spec: TableSpec) -> Column:
    """The compound id as text, ``parent/…/id``."""
    return F.concat_ws("/", *[F.col(c).cast("string") for c in spec.pk])
