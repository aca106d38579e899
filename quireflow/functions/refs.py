"""Compound ids, storage keys, pointers and object references as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow.functions.hashing import digest, object_hash
from quireflow.specs import Storage

_NO_TEXT = "cast(null as string)"


def compound_id(*keys: Column) -> Column:
    """``parent/…/id``."""
    return F.concat_ws("/", *[k.cast("string") for k in keys])


def storage_key(storage: Storage, cid: Column, suffix: Column | None = None) -> Column:
    """Key of an object in its store. The field's name is not part of it."""
    head = storage.dir if storage.kind == "asset" else storage.prefix
    parts = ([F.lit(head)] if head is not None else []) + [cid] + ([suffix] if suffix is not None else [])
    return F.concat_ws("/", *parts)


def pointer(
    storage: Storage,
    cid: Column,
    content: Column | None = None,
    text: bool = True,
    suffix: Column | None = None,
) -> Column:
    """Where the object lies. All kinds share one struct with a ``type`` and nullable arms."""
    null = F.expr(_NO_TEXT)
    key = storage_key(storage, cid, suffix)
    arms: dict[str, Column] = {}
    if storage.kind == "r2":
        arms = {"bucket": F.lit(storage.bucket), "key": key}
    elif storage.kind == "kv":
        arms = {"namespace": F.lit(storage.namespace), "key": key}
    elif storage.kind == "asset":
        arms = {"path": key}
    elif content is None:
        raise ValueError("an inline pointer carries the content")
    else:
        arms = {"content": content if text else base64_text(content), "base64": F.lit(not text)}
    names = ("bucket", "namespace", "key", "path", "content")
    return F.struct(
        F.lit(storage.kind).alias("type"),
        *[arms.get(n, null).alias(n) for n in names],
        arms.get("base64", F.lit(None)).cast("boolean").alias("base64"),
    )


def pointer_uri(p: Column) -> Column:
    kind = p["type"]
    return (
        F.when(kind == "r2", F.concat(F.lit("r2://"), p["bucket"], F.lit("/"), p["key"]))
        .when(kind == "asset", F.concat(F.lit("asset://"), p["path"]))
        .when(kind == "kv", F.concat(F.lit("kv://"), p["namespace"], F.lit("/"), p["key"]))
        .otherwise(F.lit("inline://..."))
    )


def object_ref(
    content: Column,
    content_type: Column,
    where: Column,
    meta: Column | None = None,
) -> Column:
    """Hash, size in bytes, type, meta and pointer of a payload kept at ``where``."""
    return known_object(digest(content), F.octet_length(content), content_type, where, meta)


def known_object(
    content_hash: Column, size: Column, content_type: Column, where: Column, meta: Column | None = None
) -> Column:
    """The same from the payload's digest and size, where the payload itself is not at hand."""
    no_meta = F.expr("cast(null as struct<width:int,height:int,blurhash:string,derived_id:string>)")
    return F.struct(
        object_hash(content_hash, where).alias("hash"),
        size.cast("bigint").alias("size"),
        content_type.alias("content_type"),
        (no_meta if meta is None else meta).alias("meta"),
        where.alias("pointer"),
    )


def image_meta(width: Column, height: Column, derived_id: Column) -> Column:
    return F.struct(
        width.cast("int").alias("width"),
        height.cast("int").alias("height"),
        F.expr(_NO_TEXT).alias("blurhash"),
        derived_id.alias("derived_id"),
    )


def base64_text(content: Column) -> Column:
    """Base64 in one line, whatever the session's chunking option says."""
    return F.translate(F.base64(content), "\r\n", "")


def id_from_path(path: Column) -> Column:
    """Drop one leading ``./``, then one leading ``/``, then one trailing ``/``."""
    return F.regexp_replace(F.regexp_replace(path, r"^(\./)?/?", ""), "/$", "")


def id_from_url(url: Column) -> Column:
    """Percent-encode all but unreserved characters."""
    form = F.url_encode(url)
    for have, want in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(have), F.lit(want))
    return form


def embeds_svg(size: Column, threshold: int) -> Column:
    """Small vector images go into the page, others into a store."""
    return F.when(size < threshold, "embed").otherwise("store")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


