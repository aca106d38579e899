"""Documents to tables: scan, decode, validate, flatten, resolve files, images and Markdown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import hashing, markup, refs
from quireflow.functions.mime import with_content_type
from quireflow.operators import nested, report, validate
from quireflow.operators.dedup import last_wins
from quireflow.operators.joins import all_of, key_join
from quireflow.session import settle
from quireflow.sources import attachments, corpus, decode
from quireflow.specs import CollectionSpec, Storage, TableSpec, children_of

LETTER = "source_entry string, id string, field string, code string, expected string, got string"


@dataclass(frozen=True)
class Compiled:
    """Tables in schema order, rejected documents and references, what there is to upload, and each document's status."""

    tables: dict[str, DataFrame]
    dead_letters: DataFrame
    uploads: DataFrame
    entries: DataFrame


def records_of(docs: DataFrame, collection: CollectionSpec) -> DataFrame:
    """(__source, __doc_hash, record, decode_error) of documents (source_entry, text)."""
    docs = docs.select(
        F.regexp_replace("source_entry", "^file:/+", "/").alias(nested.SOURCE),
        "text",
        hashing.document_hash(collection.config_text, F.col("text")).alias(nested.DOC_HASH),
    )
    keep = [nested.SOURCE, nested.DOC_HASH]
    if collection.syntax == "markdown":
        return decode.markdown_records(docs, keep, "text", collection.body_column or "body")
    return decode.decode(docs, keep, F.col("text"), F.lit(collection.syntax))


def compile_documents(
    spark: SparkSession,
    collection: CollectionSpec,
    folder: str,
    pattern: str = "*",
    files: DataFrame | None = None,
    mode: str = "deadletter",
) -> Compiled:
    """Compile a corpus. ``files`` holds (path, content, length), by default all files of the folder."""
    docs = corpus.scan(spark, folder, pattern, collection.config_text)
    known = attachments.scan(spark, folder) if files is None else files
    return compile_records(spark, collection, records_of(docs, collection), known, mode)


def compile_records(
    spark: SparkSession,
    collection: CollectionSpec,
    records: DataFrame,
    files: DataFrame,
    mode: str = "deadletter",
) -> Compiled:
    """Compile decoded documents, of a corpus or of a micro-batch.

    Rows for http(s) sources may be in ``files`` under their URL; nothing is fetched.
    Validated documents are written once and every table is read from there.
    """
    specs = collection.tables()
    records = settle_checked(records, collection, mode)
    good = records.where(F.size("errors") == 0).select(nested.SOURCE, nested.DOC_HASH, "row.*")
    known = _known_files(files)
    lost = _lost(nested.frames(good, collection), specs, known)
    if mode == "failfast":
        good = _stop_at(good, lost, specs[collection.table])
    else:
        lost = settle(lost, "lost")
        if not lost.isEmpty():
            # A document that names a file that is not there is rejected as a whole, like one with a bad value.
            good = good.join(lost.select(F.col("source_entry").alias(nested.SOURCE)).distinct(), nested.SOURCE, "left_anti")
    letters = [validate.dead_letters(records.withColumnRenamed(nested.SOURCE, "source_entry")), lost]
    frames = nested.frames(good, collection)
    resolved: dict[str, DataFrame] = {}
    for name, spec in reversed(list(specs.items())):  # children first: stored Markdown holds its row's children
        if name in frames:
            resolved[name] = _resolve(frames[name], spec, known, [c for c in children_of(specs, name) if c.name in frames], resolved)
        else:
            resolved[name] = _image_rows(frames[spec.parent or ""], spec, specs, known)
    tables: dict[str, DataFrame] = {}
    uploads: list[DataFrame] = []
    for name, spec in specs.items():
        rows = _unique(resolved[name], spec)
        tables[name] = rows.select(*[c for c in spec.columns if c in rows.columns])
        uploads += _uploads(rows, spec)
    blank = spark.createDataFrame([], LETTER)
    # A document without errors of its own is done unless a file of it is lost.
    own = records.select(F.col(nested.SOURCE).alias("entry"), F.when(F.size("errors") == 0, report.DONE).otherwise(report.FAILED).alias("status"))
    of_lost = lost.select(F.col("source_entry").alias("entry"), F.lit(report.FAILED).alias("status"))
    entries = own.unionByName(of_lost).groupBy("entry").agg(F.max("status").alias("status"))
    return Compiled(
        tables,
        reduce(DataFrame.unionByName, [df.select(*blank.columns) for df in letters], blank),
        reduce(DataFrame.unionByName, uploads) if uploads else spark.createDataFrame([], _UPLOAD),
        entries,
    )


def upload_log(done: Compiled, actions: DataFrame) -> DataFrame:
    """(entry, status, uri): what a run did with the objects of each document, for the reports of ``operators.report``.

    ``actions`` are those that ``run_batch`` returns. An object's hash covers its place, so it joins one action.
    """
    status = F.when(F.col("action") == "upload", report.UPLOADED).otherwise(report.SKIPPED).alias("status")
    written = actions.where("action <> 'delete'").select("hash", status, "uri")
    return done.uploads.select("hash", F.col("source_entry").alias("entry")).join(written, "hash").select("entry", "status", "uri")


def _lost(frames: Mapping[str, DataFrame], specs: Mapping[str, TableSpec], files: DataFrame) -> DataFrame:
    """A letter for each file, image or Markdown image that a document names and no file was found for.

    Each document's references are narrow rows; all kinds of all tables meet the known paths in one join.
    """
    named = []
    for name, frame in frames.items():
        spec = specs[name]
        key = refs.compound_id(*[F.col(k) for k in spec.pk])
        for field, f in spec.fields:
            if field not in frame.columns:
                continue
            if f.kind in ("file", "image") and f.storage is not None:
                used = frame.select(nested.SOURCE, key.alias("id"), F.col(field).alias("got"))
            elif f.kind == "markdown" and f.image is not None:
                used = _used_images(frame, [nested.SOURCE, key.alias("id")], field).select(nested.SOURCE, "id", F.col("url").alias("got"))
            else:
                continue
            named.append(used.withColumn("field", F.lit(field)))
    if not named:
        return frames[next(iter(frames))].sparkSession.createDataFrame([], LETTER)
    wanted = reduce(DataFrame.unionByName, named).where(F.col("got").isNotNull()).distinct()
    # A data URL brings its own bytes, if it can be read.
    wanted = wanted.where(attachments.data_url(F.col("got"))["body"].isNull()).withColumn("__path", _source_path(F.col("got")))
    unknown = wanted.join(files.select("__path"), "__path", "left_anti")
    null = F.lit(None).cast("string")
    return unknown.select(
        F.col(nested.SOURCE).alias("source_entry"), "id", "field", F.lit("LoadFailed").alias("code"), null.alias("expected"), "got"
    )


def _stop_at(good: DataFrame, lost: DataFrame, root: TableSpec) -> DataFrame:
    """The documents, in a plan that fails on the first one with a lost file, whichever table is asked for."""
    first = lost.groupBy(F.col("source_entry").alias(nested.SOURCE)).agg(F.min(F.struct("field", "got")).alias("__lost"))
    message = F.concat(
        F.lit("bad document: "), F.col(nested.SOURCE), F.lit(" LoadFailed "), F.col("__lost.field"), F.lit(" "), F.col("__lost.got")
    )
    stop = F.when(F.col("__lost").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col(root.id_name))
    return good.join(first, nested.SOURCE, "left").withColumn(root.id_name, stop).drop("__lost")


def settle_checked(records: DataFrame, collection: CollectionSpec, mode: str) -> DataFrame:
    """(__source, __doc_hash, errors, row): checked documents, written once."""
    checked = validate.with_errors(records, collection)
    failed = F.struct(
        F.lit("?").alias("id"),
        F.lit("").alias("field"),
        F.col("decode_error").alias("code"),
        F.lit(None).cast("string").alias("expected"),
        F.lit(None).cast("string").alias("got"),
    )
    errors = F.when(F.col("decode_error").isNotNull(), F.array(failed)).otherwise(F.col("errors"))
    if mode == "failfast":
        message = F.concat(F.lit("bad document: "), F.col(nested.SOURCE), F.lit(" "), F.to_json(errors))
        stop = F.raise_error(message).cast(checked.schema["errors"].dataType)
        errors = F.when(F.size(errors) > 0, stop).otherwise(errors)
    elif mode != "deadletter":
        raise ValueError(f"unknown mode {mode!r}")
    row = validate.typed_struct(collection)
    out = checked.select(nested.SOURCE, nested.DOC_HASH, errors.alias("errors"), row.alias("row"))
    return settle(out, "documents")


def _known_files(files: DataFrame) -> DataFrame:
    """Digest, size, type and image dimensions per path; contents stay behind."""
    sized = files.select(
        _file_path().alias("__path"),
        F.col("content").alias("__content"),
        F.col("length").cast("bigint").alias("__size"),
        hashing.digest(F.col("content")).alias("__digest"),
        attachments.image_size(F.col("content")).alias("__image"),
    )
    return with_content_type(sized, F.col("__path"), "__type")


def _file_path() -> Column:
    """The path that sources are looked up by; URLs stay as they are."""
    return F.when(F.col("path").rlike("^https?://"), F.col("path")).otherwise(attachments.normal_path(F.col("path")))


def _source_path(src: Column) -> Column:
    remote = src.rlike("^(?:https?://|data:)")
    return F.when(remote, src).otherwise(attachments.beside(F.col(nested.SOURCE), src))


def _derived_id(src: Column) -> Column:
    return F.when(src.rlike("^(?:https?|data):"), refs.id_from_url(src)).otherwise(refs.id_from_path(src))


def _attach(rows: DataFrame, src: str, files: DataFrame, key: list[str], inline: bool) -> DataFrame:
    """Rows with the file their source names in ``__f``; null if it is unknown.

    The file's content goes along only for inline storage. Data URLs bring their own.
    """
    content = F.col("__content") if inline else F.lit(None).cast("binary")
    narrow = files.select(
        "__path",
        F.struct(
            F.col("__digest").alias("digest"),
            F.col("__size").alias("size"),
            F.col("__type").alias("type"),
            F.col("__image").alias("image"),
            content.alias("content"),
        ).alias("__f"),
    )
    wanted = rows.withColumn("__path", _source_path(F.col(src)))
    joined = key_join(wanted, narrow, ["__path"], "left")
    data = attachments.data_url(F.col(src))
    own = F.struct(
        hashing.digest(data["body"]).alias("digest"),
        F.octet_length(data["body"]).cast("bigint").alias("size"),
        data["content_type"].alias("type"),
        attachments.image_size(data["body"]).alias("image"),
        (data["body"] if inline else F.lit(None).cast("binary")).alias("content"),
    )
    return joined.withColumn("__f", F.coalesce(F.when(data["body"].isNotNull(), own), F.col("__f")))


def _reference(storage: Storage, key: list[str], src: Column, image: bool) -> Column:
    """Object reference of the file in ``__f``."""
    f = F.col("__f")
    where = refs.pointer(
        storage, refs.compound_id(*[F.col(k) for k in key]), F.coalesce(f["content"], F.lit(b"")), text=False
    )
    meta = refs.image_meta(f["image"]["width"], f["image"]["height"], _derived_id(src)) if image else None
    return F.when(f.isNotNull(), refs.known_object(f["digest"], f["size"], f["type"], where, meta))


def _resolve(
    frame: DataFrame, spec: TableSpec, files: DataFrame, children: Sequence[TableSpec], resolved: Mapping[str, DataFrame]
) -> DataFrame:
    """Replace the sources in object columns by references and set the row hash.

    Markdown comes last: its stored form embeds the row with all else resolved.
    """
    rows, digests, image_digests = frame, [], []
    fields = [(name, f) for name, f in spec.fields if name in frame.columns]
    for name, f in fields:
        if f.kind not in ("file", "image") or f.storage is None:
            continue
        src = f"__src_{name}"
        inline = f.storage.kind == "inline"
        rows = _attach(rows.withColumnRenamed(name, src), src, files, spec.pk, inline)
        rows = rows.withColumn(name, _reference(f.storage, spec.pk, F.col(src), f.kind == "image"))
        if f.kind == "file":
            rows = rows.withColumn(f"__digest_{name}", F.col("__f.digest"))
            digests.append(F.col(f"__digest_{name}"))
        rows = rows.withColumn(f"__at_{name}", F.col("__path")).drop("__f", "__path")
    if spec.hash_name:
        for name, f in fields:
            if f.kind == "markdown" and f.image is not None:
                rows = _with_image_digests(rows, frame, spec, name, files)
                image_digests.append(F.col(f"__images_{name}"))
        own = F.concat(F.array_compact(F.array(*digests).cast("array<string>")), *image_digests)
        rows = rows.withColumn(spec.hash_name, hashing.row_hash(spec, F.col(nested.DOC_HASH), own))
    front = [n for n, f in spec.fields if n in rows.columns and f.kind != "markdown"]
    stored_texts = [(name, f) for name, f in fields if f.kind == "markdown" and f.storage is not None]
    if stored_texts:
        for child in children:
            rows = _with_children(rows, spec, child, resolved[child.name])
    for name, f in stored_texts:
        stored = f"__doc_{name}"
        rows = rows.withColumn(stored, stored_markdown(F.struct(*spec.inherit_ids, *front), F.col(name)))
        where = refs.pointer(f.storage, refs.compound_id(*[F.col(k) for k in spec.pk]), F.col(stored))
        ref = refs.object_ref(F.col(stored), F.lit("application/json"), where)
        rows = rows.withColumn(name, F.when(F.col(stored).isNotNull(), ref))
    return rows


def _with_children(rows: DataFrame, spec: TableSpec, child: TableSpec, kids: DataFrame) -> DataFrame:
    """Put the resolved rows of a child table, with all their keys and without further children, in place of the raw records.

    A group is what one record of one document holds, which the document itself bounds.
    """
    field = child.path[-1]
    nested_fields = {n for n, f in child.fields if f.kind == "records"}
    body = [c for c in (*child.inherit_ids, *[n for n, _ in child.fields]) if c in kids.columns and c not in nested_fields]
    element = F.struct(F.col(nested.POS).alias("at"), F.struct(*body).alias("row"))
    source = "__child_source"
    keys = [F.col(i).alias(f"__child_{k}") for i, k in zip(child.inherit_ids, spec.pk, strict=True)]
    groups = kids.groupBy(*keys, F.col(nested.SOURCE).alias(source)).agg(F.sort_array(F.collect_list(element))["row"].alias("__child"))
    same = all_of([F.col(k) == F.col(f"__child_{k}") for k in spec.pk] + [F.col(nested.SOURCE) == F.col(source)])
    joined = rows.join(groups, same, "left")
    none = F.array().cast(groups.schema["__child"].dataType)
    found = F.when(F.col(field).isNotNull(), F.coalesce("__child", none))
    return joined.withColumn(field, found).drop("__child", source, *[f"__child_{k}" for k in spec.pk])


def _used_images(frame: DataFrame, keep: list, text: str) -> DataFrame:
    """``keep``, position and URL of the images of a Markdown field, each URL once per row."""
    urls = markup.images(F.col(text))["url"]
    used = frame.select(*keep, F.posexplode_outer(urls).alias(nested.POS, "url"))
    return used.where(F.col("url").isNotNull())


def _with_image_digests(
    rows: DataFrame, frame: DataFrame, spec: TableSpec, text: str, files: DataFrame
) -> DataFrame:
    """Add the digests of a Markdown field's images, so that a changed image changes the row hash.

    Grouped by the record itself, not by its key, so a group is what one text names.
    """
    place = "__place"
    record = [*spec.pk, nested.SOURCE, place]
    position = F.col(nested.POS) if nested.POS in frame.columns else F.lit(0)
    used = _used_images(frame.withColumn(place, position), record, text).drop(nested.POS)
    found = _attach(used, "url", files, record, inline=False).where(F.col("__f").isNotNull())
    name = f"__images_{text}"
    digests = found.groupBy(*record).agg(F.collect_set("__f.digest").alias(name))
    joined = rows.withColumn(place, position).join(digests, record, "left").drop(place)
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast("array<string>")))


def stored_markdown(front: Column, text: Column) -> Column:
    """The stored form of a Markdown field: its row as frontmatter, the text, and its structure."""
    return F.when(
        text.isNotNull(),
        F.to_json(
            F.struct(
                front.alias("frontmatter"),
                text.alias("body"),
                markup.sections(text).alias("sections"),
                markup.footnotes(text).alias("footnotes"),
            ),
            {"ignoreNullFields": "false"},
        ),
    )


def _image_rows(
    frame: DataFrame, spec: TableSpec, specs: Mapping[str, TableSpec], files: DataFrame
) -> DataFrame:
    """Rows of a markdown field's image table.

    Small vector images stay in the page.
    """
    parent = specs[spec.parent or ""]
    field = parent.field(spec.path[-1])
    threshold = field.image.embed_svg_threshold if field.image else 0
    keys = [F.col(k).alias(i) for k, i in zip(parent.pk, spec.inherit_ids, strict=True)]
    used = _used_images(frame, [*keys, nested.SOURCE, nested.DOC_HASH], spec.path[-1])
    storage = spec.field("image").storage or Storage("inline")
    found = _attach(used, "url", files, list(spec.inherit_ids), storage.kind == "inline")
    embedded = (F.col("__f.image.format") == "svg") & (F.col("__f.size") < threshold)
    found = found.where(F.col("__f").isNotNull() & ~F.coalesce(embedded, F.lit(False)))
    found = found.withColumn("src_id", _derived_id(F.col("url")))
    rows = found.withColumn("image", _reference(storage, spec.pk, F.col("url"), True))
    return rows.withColumn("__at_image", F.col("__path"))


def _unique(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per key: of documents or records that repeat a key, the last one counts."""
    order = [c for c in (nested.SOURCE, nested.POS) if c in rows.columns]
    drop = [n for n, f in spec.fields if f.kind == "records"]
    return last_wins(rows.drop(*drop), spec.pk, order) if order else rows


_UPLOAD = (
    "table_name string, hash string, size bigint, content_type string, "
    "pointer struct<type:string,bucket:string,namespace:string,key:string,path:string,content:string,base64:boolean>, "
    "payload_path string, payload_text string, source_entry string"
)


def _uploads(rows: DataFrame, spec: TableSpec) -> list[DataFrame]:
    """Objects a table refers to, with the path of their payload, or its text if it was made here, and the document they are from."""
    out = []
    null = F.lit(None).cast("string")
    for name in spec.object_cols:
        if name not in rows.columns:
            continue
        ref = F.col(name)
        at, text = f"__at_{name}", f"__doc_{name}"
        out.append(
            rows.where(ref["hash"].isNotNull()).select(
                F.lit(spec.name).alias("table_name"),
                *[ref[c].alias(c) for c in ("hash", "size", "content_type", "pointer")],
                (F.col(at) if at in rows.columns else null).alias("payload_path"),
                (F.col(text) if text in rows.columns else null).alias("payload_text"),
                (F.col(nested.SOURCE) if nested.SOURCE in rows.columns else null).alias("source_entry"),
            )
        )
    return out


def with_payload(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """Uploads with their bytes. Do it last: only contents that are to be written move.

    A data URL is its own payload; an upload without any is an error.
    """
    wanted = uploads.select("payload_path").distinct()
    known = files.select(_file_path().alias("payload_path"), "content").join(wanted, "payload_path", "left_semi")
    own = attachments.data_url(F.col("payload_path"))["body"]
    body = F.coalesce(F.col("payload_text").cast("binary"), own, F.col("content"))
    missing = F.raise_error(F.concat(F.lit("no payload for "), F.coalesce("payload_path", F.lit("an object")))).cast("binary")
    return (
        key_join(uploads, known, ["payload_path"], "left")
        .withColumn("body", F.when(body.isNull(), missing).otherwise(body))
        .drop("content", "payload_text")
    )
