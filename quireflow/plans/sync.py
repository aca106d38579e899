"""The sync plan: touch ancestors, upsert, clean up, for a whole tree of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.operators import diff
from quireflow.operators.rows import explode_structs
from quireflow.session import settle
from quireflow.specs import TableSpec, ancestors_of, children_of

Tables = Mapping[str, DataFrame]


def touched(old: Tables, new: Tables, specs: Mapping[str, TableSpec]) -> dict[str, DataFrame]:
    """Keys of the rows with a dirty descendant. Each table is compared once: its dirty keys are settled for all levels above."""
    parents = {spec.parent for spec in specs.values() if spec.parent}
    if not any(specs[p].updated_at for p in parents):
        return {}
    dirty = {
        name: settle(diff.dirty_keys(old[name], new[name], spec), f"dirty-{name}")
        for name, spec in specs.items()
        if spec.parent is not None
    }
    return diff.touched_keys(dirty, specs)


def sync_tables(
    old: Tables, new: Tables, specs: Mapping[str, TableSpec], run_ts: str
) -> dict[str, DataFrame]:
    """Each table after the run. Touch compares with the *old* state, so it goes first."""
    marked = touched(old, new, specs)
    out = {}
    for name, spec in specs.items():
        moved = diff.touch(old[name], marked.get(name), spec, run_ts)
        out[name] = diff.synced(moved, new[name], spec, run_ts)
    return out


OPS = (diff.UNCHANGED, diff.DELETE, diff.UPDATE, diff.INSERT)


def sync_changes(old: Tables, new: Tables, specs: Mapping[str, TableSpec]) -> DataFrame:
    """(table_name, key, op) for every row the run inserts, updates, touches or deletes.

    Each table is joined with its old state exactly once. A changed row sends its own
    operation and a mark for each of its ancestors' keys; one grouping by (table, key) then
    brings marks and rows together. Marks combine on the map side, so a parent with very
    many changed rows below it costs one row per task. Unchanged rows travel only
    where they can still become a touch, and as keys.
    """
    code = F.array_position(F.array(*[F.lit(o) for o in OPS]), F.col("op")).cast("int")
    sent = []
    for name, spec in specs.items():
        feed = diff.change_feed(old[name], new[name], spec).withColumn("code", code)
        changed = F.col("op") != diff.UNCHANGED
        if not (spec.updated_at and children_of(specs, name)):
            feed = feed.where(changed)
        own = _mark(name, spec.pk, F.col("code"), 0)
        above = [
            _mark(a.name, spec.inherit_ids[: len(a.pk)], F.lit(0), 1)
            for a in ancestors_of(specs, name)
            if a.updated_at
        ]
        rows = F.when(changed, F.array(own, *above)).otherwise(F.array(own))
        sent.append(explode_structs(feed, [], rows))
    # Numbers, not names: their maxima are kept in a hash aggregate, without a sort.
    grouped = (
        reduce(DataFrame.unionByName, sent)
        .groupBy("table_name", "ids")
        .agg(F.max("code").alias("code"), F.max("marked").alias("marked"))
    )
    unchanged = F.lit(OPS.index(diff.UNCHANGED) + 1)
    touched = (F.col("code") == unchanged) & (F.col("marked") == 1)
    op = F.when(touched, diff.TOUCH).otherwise(F.get(F.array(*[F.lit(o) for o in OPS]), F.col("code") - 1))
    return grouped.where((F.col("code") > unchanged) | touched).select(
        "table_name", F.array_join("ids", "/").alias("key"), op.alias("op")
    )


def _mark(table: str, key: Sequence[str], code: Column, marked: int) -> Column:
    return F.struct(
        F.lit(table).alias("table_name"),
        F.array(*[F.col(c).cast("string") for c in key]).alias("ids"),
        code.alias("code"),
        F.lit(marked).alias("marked"),
    )
