"""Writing routed objects: one folder per store, and callables for real services."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row

from quireflow.operators.objects import STORES, route

Sink = Callable[[DataFrame], None]


def write_stores(objects: DataFrame, folder: str) -> None:
    """Append all objects that have a store, in folders ``store=r2``, ``store=kv``, ``store=asset``."""
    route(objects).write.mode("append").partitionBy("store").parquet(folder)


def dispatch(objects: DataFrame, sinks: dict[str, Sink]) -> None:
    """Hand each store's objects to its sink, a function of a DataFrame."""
    unknown = set(sinks) - set(STORES)
    if unknown:
        raise ValueError(f"no such stores: {sorted(unknown)}")
    routed = route(objects)
    for store, sink in sinks.items():
        sink(routed.where(routed["store"] == store).drop("store"))


def per_partition(put: Callable[[Iterator[Row]], None]) -> Sink:
    """A sink that calls ``put`` with an iterator of rows in every task, for remote clients.

    Tasks may be retried, so ``put`` must be idempotent; puts by key are.
    """
    return lambda rows: rows.foreachPartition(put)
