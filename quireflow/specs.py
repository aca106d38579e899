"""Declared collections and the relational tables they compile to.

Everything here is driver-side metadata: a few names per table, never data.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T


class SpecError(ValueError):
    """A collection declaration that cannot be compiled."""


@dataclass(frozen=True)
class Storage:
    """Where an object column keeps its payload: r2, kv, asset or inline."""

    kind: str
    bucket: str | None = None
    namespace: str | None = None
    dir: str | None = None
    prefix: str | None = None

    def __post_init__(self) -> None:
        needs = {"r2": "bucket", "kv": "namespace", "asset": "dir", "inline": None}
        if self.kind not in needs:
            raise SpecError(f"unknown storage type {self.kind!r}")
        needed = needs[self.kind]
        if needed and not getattr(self, needed):
            raise SpecError(f"storage {self.kind!r} needs {needed!r}")

    @classmethod
    def from_config(cls, raw: Mapping[str, Any]) -> Storage:
        return cls(
            kind=raw["type"],
            bucket=raw.get("bucket"),
            namespace=raw.get("namespace"),
            dir=raw.get("dir"),
            prefix=raw.get("prefix"),
        )


POINTER_TYPE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("base64", T.BooleanType()),
    ]
)

OBJECT_TYPE = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("content_type", T.StringType()),
        T.StructField(
            "meta",
            T.StructType(
                [
                    T.StructField("width", T.IntegerType()),
                    T.StructField("height", T.IntegerType()),
                    T.StructField("blurhash", T.StringType()),
                    T.StructField("derived_id", T.StringType()),
                ]
            ),
        ),
        T.StructField("pointer", POINTER_TYPE),
    ]
)

SPARK_TYPES: dict[str, T.DataType] = {
    "id": T.StringType(),
    "hash": T.StringType(),
    "created_at": T.TimestampType(),
    "updated_at": T.TimestampType(),
    "string": T.StringType(),
    "integer": T.LongType(),
    "real": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "image": OBJECT_TYPE,
    "file": OBJECT_TYPE,
    "markdown": OBJECT_TYPE,
}

TIMESTAMPS = ("created_at", "updated_at")
OBJECT_KINDS = ("image", "file", "markdown")
ALWAYS_PRESENT = ("id", "hash", *TIMESTAMPS)


@dataclass(frozen=True)
class Field:
    """One declared field; ``records`` and ``markdown`` also open a child table."""

    kind: str
    required: bool = False
    index: bool = False
    storage: Storage | None = None
    table: str | None = None
    inherit_ids: tuple[str, ...] = ()
    schema: tuple[tuple[str, Field], ...] = ()
    image: MarkdownImages | None = None

    def __post_init__(self) -> None:
        if self.kind != "records" and self.kind not in SPARK_TYPES:
            raise SpecError(f"unknown field type {self.kind!r}")
        if self.kind == "records" and not self.table:
            raise SpecError("a records field needs a table name")
        if self.kind in OBJECT_KINDS and self.storage is None:
            raise SpecError(f"a {self.kind} field needs a storage")

    @property
    def is_timestamp(self) -> bool:
        return self.kind in TIMESTAMPS

    @property
    def nullable(self) -> bool:
        return not (self.required or self.kind in ALWAYS_PRESENT)

    @classmethod
    def from_config(cls, raw: Mapping[str, Any]) -> Field:
        storage = raw.get("storage")
        image = raw.get("image")
        return cls(
            kind=raw["type"],
            required=bool(raw.get("required", False)),
            index=bool(raw.get("index", False)),
            storage=Storage.from_config(storage) if storage else None,
            table=raw.get("table"),
            inherit_ids=tuple(raw.get("inherit_ids", ())),
            schema=fields_from_config(raw.get("schema", {})),
            image=MarkdownImages.from_config(image) if image else None,
        )


@dataclass(frozen=True)
class MarkdownImages:
    """The child table that holds the images of a markdown field."""

    table: str
    inherit_ids: tuple[str, ...]
    storage: Storage
    embed_svg_threshold: int

    @classmethod
    def from_config(cls, raw: Mapping[str, Any]) -> MarkdownImages:
        return cls(
            table=raw["table"],
            inherit_ids=tuple(raw["inherit_ids"]),
            storage=Storage.from_config(raw["storage"]),
            embed_svg_threshold=int(raw["embed_svg_threshold"]),
        )


def fields_from_config(raw: Mapping[str, Any]) -> tuple[tuple[str, Field], ...]:
    return tuple((name, Field.from_config(body)) for name, body in raw.items())


@dataclass(frozen=True)
class TableSpec:
    """One relational table; its key is the parent's whole key plus its own id."""

    name: str
    fields: tuple[tuple[str, Field], ...]
    id_name: str
    inherit_ids: tuple[str, ...] = ()
    parent: str | None = None
    parent_key: tuple[str, ...] = ()
    path: tuple[str, ...] = ()
    hash_name: str | None = None
    created_at: str | None = None
    updated_at: str | None = None

    @property
    def pk(self) -> list[str]:
        return [*self.inherit_ids, self.id_name]

    @property
    def columns(self) -> list[str]:
        """Stored columns in order; ``records`` fields are tables, not columns."""
        names = [name for name, f in self.fields if f.kind != "records"]
        return [*self.inherit_ids, *names]

    @property
    def data_cols(self) -> list[str]:
        """Columns whose change counts as a change of the row."""
        return [
            name
            for name, f in self.fields
            if f.kind not in ("id", "records") and not f.is_timestamp
        ]

    @property
    def id_only(self) -> bool:
        return sum(not f.is_timestamp for _, f in self.fields) == 1

    @property
    def object_cols(self) -> list[str]:
        return [name for name, f in self.fields if f.kind in OBJECT_KINDS]

    @property
    def struct_type(self) -> T.StructType:
        inherited = [T.StructField(name, T.StringType(), False) for name in self.inherit_ids]
        own = [
            T.StructField(name, SPARK_TYPES[f.kind], f.nullable)
            for name, f in self.fields
            if f.kind != "records"
        ]
        return T.StructType([*inherited, *own])

    def field(self, name: str) -> Field:
        return dict(self.fields)[name]


@dataclass(frozen=True)
class CollectionSpec:
    """A declared dataset: which documents, which syntax, which tables."""

    name: str
    table: str
    schema: tuple[tuple[str, Field], ...]
    glob: str = "**/*"
    syntax: str = "yaml"
    body_column: str | None = None
    database_id: str = ""
    config_text: str = field(default="", repr=False, compare=False)

    @classmethod
    def from_config(cls, raw: Mapping[str, Any], config_text: str = "") -> CollectionSpec:
        syntax = raw["syntax"]
        kind = syntax["type"]
        if kind not in ("yaml", "toml", "markdown"):
            raise SpecError(f"unknown document syntax {kind!r}")
        return cls(
            name=raw["name"],
            table=raw["table"],
            schema=fields_from_config(raw["schema"]),
            glob=raw["glob"],
            syntax=kind,
            body_column=syntax.get("column"),
            database_id=raw["database_id"],
            config_text=config_text,
        )

    def tables(self) -> dict[str, TableSpec]:
        """All tables, parents before children, depth first."""
        out: dict[str, TableSpec] = {}
        _collect(out, self.table, self.schema, (), None, (), ())
        return out


def _single(table: str, schema: tuple[tuple[str, Field], ...], kind: str) -> str | None:
    names = [name for name, f in schema if f.kind == kind]
    if len(names) > 1:
        raise SpecError(f"table {table!r} declares {kind} more than once")
    return names[0] if names else None


def _check_arity(table: str, inherit_ids: tuple[str, ...], parent_key: tuple[str, ...]) -> None:
    if len(inherit_ids) != len(parent_key):
        raise SpecError(
            f"table {table!r} inherits {len(inherit_ids)} ids, its parent's key has {len(parent_key)}"
        )


def _collect(
    out: dict[str, TableSpec],
    table: str,
    schema: tuple[tuple[str, Field], ...],
    inherit_ids: tuple[str, ...],
    parent: str | None,
    parent_key: tuple[str, ...],
    path: tuple[str, ...],
) -> None:
    _check_arity(table, inherit_ids, parent_key)
    ids = [name for name, f in schema if f.kind == "id"]
    if not ids:
        raise SpecError(f"table {table!r} declares no id")
    hashes = [name for name, f in schema if f.kind == "hash"]
    spec = TableSpec(
        name=table,
        fields=schema,
        id_name=ids[0],
        inherit_ids=inherit_ids,
        parent=parent,
        parent_key=parent_key,
        path=path,
        hash_name=hashes[-1] if hashes else None,
        created_at=_single(table, schema, "created_at"),
        updated_at=_single(table, schema, "updated_at"),
    )
    out[table] = spec
    key = tuple(spec.pk)
    for name, f in schema:
        if f.kind == "records":
            _collect(out, f.table or name, f.schema, f.inherit_ids, table, key, (*path, name))
        elif f.kind == "markdown" and f.image is not None:
            _check_arity(f.image.table, f.image.inherit_ids, key)
            out[f.image.table] = TableSpec(
                name=f.image.table,
                fields=(
                    ("src_id", Field("id")),
                    ("image", Field("image", required=True, storage=f.image.storage)),
                ),
                id_name="src_id",
                inherit_ids=f.image.inherit_ids,
                parent=table,
                parent_key=key,
                path=(*path, name),
            )


def children_of(specs: Mapping[str, TableSpec], table: str) -> list[TableSpec]:
    return [spec for spec in specs.values() if spec.parent == table]


def ancestors_of(specs: Mapping[str, TableSpec], table: str) -> list[TableSpec]:
    """Parent, its parent, and so on up to the root."""
    out = []
    above = specs[table].parent
    while above is not None:
        out.append(specs[above])
        above = specs[above].parent
    return out
