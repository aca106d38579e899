"""The list of named queries, each next to the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quireflow.sources.tables import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return register


# Tables already opened in this application: plans only, never rows.
_READ: dict[tuple[str, str, str, bool], DataFrame] = {}

# Unique keys of the tables on which costly per-row work is done.
KEYS = {
    "documents": ["doc_id"],
    "pages": ["page_id"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
}


def table(spark: SparkSession, sf_dir: str, name: str, costly: bool = False) -> DataFrame:
    """A given table; with ``costly``, spread over all cores if it is small."""
    place = (spark.sparkContext.applicationId, sf_dir, name, costly)
    if place not in _READ:
        rows = read_table(spark, sf_dir, name)
        _READ[place] = spread(rows, *KEYS[name]) if costly else rows
    return _READ[place]
