"""Content digests. Used for equality only, so SHA-256 from Spark's own functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow.specs import TableSpec


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def document_hash(config_text: str, text: Column) -> Column:
    """Digest of the collection's configuration followed by the whole document."""
    return digest(F.concat(F.lit(config_text), text))


def row_hash(spec: TableSpec, doc_hash: Column, digests: Column | None = None) -> Column:
    """Digest of a row: its document, its field names, its files' digests.

    It starts from the *document*, so any edit of a document changes the hash of
    all its rows, children included. ``digests`` is an array of the digests of files and
    markdown images; it is sorted, and image fields do not take part.
    """
    names = [F.lit(name) for name, f in spec.fields if not f.is_timestamp]
    parts = [doc_hash, *names]
    if digests is not None:
        parts.append(F.array_join(F.array_sort(digests), "\n"))
    return digest(F.concat_ws("\n", *parts))


def object_hash(content_hash: Column, pointer: Column) -> Column:
    """Digest that moves with the object: content, store kind and location.

    An inline object has no location, so equal inline contents share one hash.
    """
    parts: Sequence[Column] = [pointer[p] for p in ("bucket", "namespace", "key", "path")]
    return digest(
        F.concat(content_hash, pointer["type"], *[F.coalesce(p, F.lit("")) for p in parts])
    )


def common_prefix_length(a: Column, b: Column) -> Column:
    """Number of leading characters two strings share."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))
    )
    first_difference = F.array_position(same, False)
    return F.when(n == 0, 0).when(first_difference == 0, n).otherwise(first_difference - 1).cast("int")
