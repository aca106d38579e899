from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, block string"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with clashing extra columns, from (doc_id, text[, lang, source]) rows."""

    def table(rows):
        full = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1]), "x", "y") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return table


@pytest.fixture(scope="session")
def odd():
    """Null ids and texts, empty texts, repeated rows, ties, a very long text and a very long word."""
    return [
        (1, None), (2, ""), (3, " \n\t"), (None, "alpha beta gamma delta"), (4, "same words here again and more"),
        (4, "same words here again and more"), (5, "same words here again and more"), (6, "word " * 30_000),
        (7, "x" * 5000), (8, "é ü ß 123 !!!", "de", "b"), (9, "12345", "en", "a"), (700, "held out of the model", "en", None),
    ]
