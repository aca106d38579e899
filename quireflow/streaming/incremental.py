"""Structured Streaming wrappers: micro-batches and keyed state written to a snapshot store."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quireflow.operators import diff
from quireflow.operators.joins import anti_by_key, semi_by_key
from quireflow.operators.objects import inventory, route, to_upload, with_location
from quireflow.session import settle
from quireflow.sinks.objects import Sink
from quireflow.sources import corpus
from quireflow.sinks.snapshots import Run, SnapshotStore, bucket_of
from quireflow.specs import TableSpec

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW, SINCE = "__row", "__since"

Compile = Callable[[DataFrame], dict[str, DataFrame]]


def document_stream(spark: SparkSession, folder: str, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    """New files below a folder as (source_entry, text), each read as a whole."""
    files = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", str(per_batch))
        .text(folder, wholetext=True)
    )
    return files.selectExpr("_metadata.file_path AS source_entry", "value AS text")


def shard_stream(spark: SparkSession, folder: str, per_batch: int = 16) -> DataFrame:
    """Documents of new shards below a folder as (source_entry, text); a batch takes ``per_batch`` shards."""
    return spark.readStream.schema(corpus.SHARD).option("maxFilesPerTrigger", str(per_batch)).parquet(folder)


def upsert_stream(
    documents: DataFrame,
    store: SnapshotStore,
    specs: dict[str, TableSpec],
    compile_batch: Compile,
    run_ts: Callable[[int], str],
    checkpoint: str,
    upload: Sink | None = None,
) -> StreamingQuery:
    """Compile each micro-batch to tables and upsert them, all tables in one commit; never deletes.

    Objects whose hash is not stored yet go to ``upload`` first, so that no row is ever
    there before its object.

    A batch sees only the documents that arrived, so rows that are not in it are kept:
    deletion needs a whole snapshot and is the periodic batch's task. A replayed batch
    changes nothing, since equal rows are left alone.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        tables = compile_batch(batch)
        if upload is not None:
            upload(fresh_objects(store, specs, tables))
        run = store.begin()
        for name, rows in tables.items():
            merge_batch(run, specs[name], rows, run_ts(batch_id))
        run.commit()

    return (
        documents.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fresh_objects(
    store: SnapshotStore, specs: dict[str, TableSpec], tables: dict[str, DataFrame]
) -> DataFrame:
    """Objects the batch refers to and no stored row does yet."""
    named = {name: specs[name] for name in tables}
    incoming = routed_inventory(store.spark, tables, named)
    old = {name: store.read(name) for name in tables}
    known = {name: rows for name, rows in old.items() if rows is not None}
    if not known:
        return incoming
    stored = routed_inventory(store.spark, known, {name: specs[name] for name in known})
    return to_upload(incoming, stored)


def routed_inventory(
    spark: SparkSession, tables: dict[str, DataFrame], specs: dict[str, TableSpec]
) -> DataFrame:
    return route(with_location(inventory(spark, tables, specs)))


def merge_batch(run: Run, spec: TableSpec, rows: DataFrame, run_ts: str) -> None:
    """Stage the batch's new and changed rows as a delta of the stored table.

    What is read of the stored table are the rows of the batch's keys, in the buckets these fall in, and what is
    written is what changed: the cost follows the batch, but for the buckets rewritten once there are many deltas.
    """
    state = run.state(spec.name)
    stamps = [c for c in (spec.created_at, spec.updated_at) if c]
    if state is None:
        first = rows.select(*spec.pk, *spec.data_cols, *[diff.run_timestamp(run_ts).alias(c) for c in stamps])
        run.replace(spec.name, first, spec.pk, ignore=stamps)
        return
    rows = settle(rows.select(*spec.pk, *spec.data_cols), f"batch-{spec.name}")
    touched = [r[0] for r in rows.select(bucket_of(state.by, state.buckets)).distinct().collect()]
    stored = semi_by_key(run.read(spec.name, touched), rows, spec.pk)
    if spec.data_cols:
        rows = diff.incoming_changes(stored, rows, spec)
        # Rows that are equal to the stored ones are not written again.
        stored = semi_by_key(stored, rows, spec.pk)
        run.append(spec.name, diff.upsert(stored, rows, spec, run_ts))
    else:
        fresh = anti_by_key(rows, stored, spec.pk)
        run.append(spec.name, fresh.select("*", *[diff.run_timestamp(run_ts).alias(c) for c in stamps]))
    run.compact(spec.name)


def latest_stream(
    updates: DataFrame,
    store: SnapshotStore,
    table: str,
    key: Sequence[str],
    order: Sequence[str],
    checkpoint: str,
) -> StreamingQuery:
    """Keep the latest row per key of an update stream, across batches, in a stored table.

    Each key's latest row is state of the query's aggregate, kept in RocksDB beside the checkpoint. A batch hands on
    only the keys whose latest row has changed, which go to the store as a delta: nothing stored is read or
    rewritten for it. Late rows lose against the state, so batches may come in any order; a
    replayed batch starts from the state it started from before and adds equal rows.

    Rows of a key compare by ``order``, then by the other columns; null is the least. Keys that are many in a batch are cut down to one row
    for each task before the shuffle.
    """
    spark = updates.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = updates.columns
    # The batch's own time, which is the same in all its rows and in its replay. Of equal rows the first one to come counts.
    since = -F.unix_millis(F.current_timestamp())
    row = F.struct(*order, *[c for c in names if c not in key and c not in order], SINCE)
    best = updates.withColumn(SINCE, since).groupBy(*key).agg(F.max(row).alias(ROW))
    changed = best.where(F.col(f"{ROW}.{SINCE}") == since)
    latest = changed.select(*[F.col(c) if c in key else F.col(f"{ROW}.`{c}`").alias(c) for c in names])

    def apply(batch: DataFrame, batch_id: int) -> None:
        run = store.begin()
        if run.state(table) is None:
            run.replace(table, batch, key)
        else:
            run.append(table, batch)
            run.compact(table)
        run.commit()

    return (
        latest.writeStream.foreachBatch(apply)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
