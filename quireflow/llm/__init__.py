"""Operators of a training-data pipeline; see the README for the list and what each one does."""

from quireflow.llm.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
