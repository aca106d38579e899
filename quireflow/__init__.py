"""quireflow: schema-driven content-table sync on Spark DataFrames."""

from quireflow.specs import CollectionSpec, Field, SpecError, Storage, TableSpec

__all__ = ["CollectionSpec", "Field", "SpecError", "Storage", "TableSpec"]
