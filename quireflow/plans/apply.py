"""A whole run against a snapshot store."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.operators import diff
from quireflow.plans.lifecycle import object_actions
from quireflow.plans.sync import touched
from quireflow.session import settle, work_dir
from quireflow.sinks.snapshots import BUCKET, Run, SnapshotStore, TableState, View, bucket_digests, bucket_of
from quireflow.specs import TableSpec


def stored_tables(store: SnapshotStore, specs: Mapping[str, TableSpec], new: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Current tables; one that was never written is empty, with the incoming columns."""
    out = {}
    for name, spec in specs.items():
        found = store.read(name)
        if found is None:
            stamps = [c for c in (spec.created_at, spec.updated_at) if c]
            blank = store.spark.createDataFrame([], spec.struct_type)
            found = diff.empty_like(new[name]) if name in new else blank
            for stamp in stamps:
                found = found.withColumn(stamp, diff.run_timestamp("1970-01-01 00:00:00"))
        out[name] = found
    return out


def complete(specs: Mapping[str, TableSpec], new: Mapping[str, DataFrame], like: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Incoming tables; one that is missing from the input is empty, so all its rows go."""
    return {
        name: new[name] if name in new else diff.empty_like(like[name]).select(*spec.pk, *spec.data_cols)
        for name, spec in specs.items()
    }


def sync_store(
    store: SnapshotStore, specs: Mapping[str, TableSpec], incoming: Mapping[str, DataFrame], run_ts: str, force: bool = False
) -> dict[str, DataFrame]:
    """Sync all tables with the stored ones and make the new state current in one commit.

    Incoming tables are written once, in the buckets of the stored ones. Only buckets whose digests differ are compared, and only those
    and the buckets of touched ancestors are written; a table without any keeps its state, and a run without changes adds no commit.
    """
    run = store.begin()
    view = run.view
    if not any(name in view.tables for name in specs):
        return _first(store, run, specs, incoming, run_ts)
    cuts = {name: _cut(store, incoming[name], spec, None if force else view.tables.get(name)) for name, spec in specs.items()}

    def both(chosen: Mapping[str, list[int]]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        old = {n: cuts[n].stored(view, chosen[n]) for n in specs}
        return old, {n: cuts[n].incoming(chosen[n]) for n in specs}

    marked = touched(*both({n: c.dirty for n, c in cuts.items()}), specs)
    marked = {n: settle(keys, f"touched-{n}") for n, keys in marked.items()}
    chosen = {n: sorted({*c.dirty, *c.buckets_of(marked.get(n), specs[n])}) for n, c in cuts.items()}
    old, new = both(chosen)
    for name, spec in specs.items():
        if chosen[name] or cuts[name].state is None:
            rows = diff.synced(diff.touch(old[name], marked.get(name), spec, run_ts), new[name], spec, run_ts)
            stamps = [c for c in (spec.created_at, spec.updated_at) if c]
            run.replace(name, rows, spec.pk, None if cuts[name].state is None else chosen[name], ignore=stamps)
    view = store.at(run.commit())
    return {name: view.read(name) for name in specs}


def _first(
    store: SnapshotStore, run: Run, specs: Mapping[str, TableSpec], incoming: Mapping[str, DataFrame], run_ts: str
) -> dict[str, DataFrame]:
    """Sync with a store that has none of the tables: all rows are inserts, so they are neither staged nor compared."""
    for name, spec in specs.items():
        stamps = [c for c in (spec.created_at, spec.updated_at) if c]
        rows = incoming[name].select(*spec.pk, *spec.data_cols, *[diff.run_timestamp(run_ts).alias(c) for c in stamps])
        run.replace(name, rows, spec.pk, ignore=stamps)
    view = store.at(run.commit())
    return {name: view.read(name) for name in specs}


def changed_rows(store: SnapshotStore, spec: TableSpec, incoming: DataFrame) -> DataFrame:
    """(key…, op) of what a sync would insert, update or delete; of the stored table only buckets that differ are read."""
    view = store.at()
    cut = _cut(store, incoming, spec, view.tables.get(spec.name))
    feed = diff.change_feed(cut.stored(view, cut.dirty), cut.incoming(cut.dirty), spec)
    return feed.where(F.col("op") != diff.UNCHANGED)


@dataclass(frozen=True)
class _Cut:
    """An incoming table in buckets, beside the stored state it is compared with, if there is a fitting one."""

    rows: DataFrame
    spec: TableSpec
    state: TableState | None
    buckets: int
    dirty: list[int]

    def incoming(self, buckets: list[int]) -> DataFrame:
        return self.rows.where(F.col(BUCKET).isin(buckets)).drop(BUCKET)

    def stored(self, view: View, buckets: list[int]) -> DataFrame:
        if self.state is not None:
            return view.read(self.spec.name, buckets)
        empty = self.incoming([])
        for stamp in (self.spec.created_at, self.spec.updated_at):
            if stamp:
                empty = empty.withColumn(stamp, diff.run_timestamp("1970-01-01 00:00:00"))
        return empty

    def buckets_of(self, keys: DataFrame | None, spec: TableSpec) -> list[int]:
        """Buckets of stored rows with these keys; as many numbers as buckets at most."""
        if keys is None or self.state is None:
            return []
        kinds = dict(self.state.columns())
        typed = keys.select(*[F.col(c).cast(kinds[c]) for c in spec.pk])
        return [r[0] for r in typed.select(bucket_of(self.state.by, self.buckets)).distinct().collect()]


def _cut(store: SnapshotStore, incoming: DataFrame, spec: TableSpec, state: TableState | None) -> _Cut:
    rows = incoming.select(*spec.pk, *spec.data_cols)
    if state is not None:
        stamps = [c for c in (spec.created_at, spec.updated_at) if c]
        kinds = dict(state.columns())
        if state.key != tuple(spec.pk) or set(kinds) != {*rows.columns, *stamps}:
            state = None  # declared anew since: the table is written as a whole
        else:
            rows = rows.select(*[F.col(c).cast(kinds[c]) for c in rows.columns])
    n = state.buckets if state else store.buckets
    folder = work_dir(store.spark, f"incoming-{spec.name}")
    rows.withColumn(BUCKET, bucket_of(state.by if state else spec.pk, n)).repartition(BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(folder)
    whole = T.StructType([*rows.schema.fields, T.StructField(BUCKET, T.IntegerType())])
    staged = store.spark.read.schema(whole).parquet(folder)
    dirty = state.dirty(bucket_digests(staged, state.digested)) if state else list(range(n))
    return _Cut(staged, spec, state, n, dirty)


def run_batch(
    store: SnapshotStore,
    specs: Mapping[str, TableSpec],
    new: Mapping[str, DataFrame],
    run_ts: str,
    force: bool = False,
    upload: Callable[[DataFrame], None] | None = None,
    delete: Callable[[DataFrame], None] | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Upload new objects, sync all tables in one commit, delete objects that are gone.

    ``upload`` and ``delete`` get the actions of their kind: a row never points to an
    object that is not there yet, and an object goes only after no row names it. The actions are
    settled first, since they compare with the old versions. Returns the tables and all actions. With
    ``force`` the run is a full refresh: the stored state counts as empty and every object is uploaded.
    """
    old = stored_tables(store, specs, new)
    incoming = complete(specs, new, old)
    actions = settle(object_actions(store.spark, old, incoming, specs, force), "actions")
    if upload is not None:
        upload(actions.where("action = 'upload'"))
    tables = sync_store(store, specs, incoming, run_ts, force)
    if delete is not None:
        delete(actions.where("action = 'delete'"))
    return tables, actions
