"""Named queries over the given tables, each with the SQL that states its result."""

from quireflow.catalog import (  # noqa: F401
    diff_queries,
    markup_queries,
    nested_queries,
    object_queries,
    report_queries,
    source_queries,
    typed_queries,
)
from quireflow.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
