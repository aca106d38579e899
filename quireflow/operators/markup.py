"""Feature tables over a corpus of Markdown documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions import markup, refs
from quireflow.functions.languages import with_language
from quireflow.operators.joins import key_join
from quireflow.operators.rows import explode_structs, explode_values
from quireflow.specs import Storage


def features(docs: DataFrame, key: Sequence[str], array: Column) -> DataFrame:
    """One row per feature of each document, under the document's key. No shuffle."""
    return explode_structs(docs, list(key), array)


def code_blocks(docs: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key…, seq, lang, title, lines, code)."""
    found = features(docs, key, markup.code_blocks(F.col(text)))
    title = markup.attribute(markup.fence_attributes(F.col("info")), "title")
    return found.select(
        *key, "seq", markup.fence_lang(F.col("info")).alias("lang"), title.alias("title"), "lines", "code"
    )


def fence_meta(docs: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key…, seq, lang, attr, value, type), one row per attribute of a fence."""
    found = features(docs, key, markup.code_blocks(F.col(text))).select(*key, "seq", "info")
    lang = markup.fence_lang(F.col("info")).alias("lang")
    rows = explode_structs(found, [*key, "seq", lang], markup.fence_attributes(F.col("info")))
    return rows.withColumnRenamed("key", "attr")


def language_usage(docs: DataFrame, text: str) -> DataFrame:
    """(language, blocks, lines) over the whole corpus; partial sums before the shuffle."""
    found = features(docs, [], markup.code_blocks(F.col(text))).select("info", "lines")
    named = with_language(found, F.coalesce(markup.fence_lang(F.col("info")), F.lit("")))
    return named.groupBy("language").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("lines").alias("lines")
    )


def isolated_links(docs: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key…, url), each URL once per document."""
    rows = explode_values(docs, list(key), markup.isolated_links(F.col(text)), "url")
    return rows.drop("pos")


def image_table(
    docs: DataFrame,
    key: Sequence[str],
    inherit_ids: Sequence[str],
    text: str,
    bodies: DataFrame,
    storage: Storage,
) -> DataFrame:
    """Child rows (inherit_ids…, src_id, image) of the images a document uses; ``image`` is null where no body was found.

    ``bodies`` holds (url, content, content_type, width, height) once per URL. Many documents may use
    one image, so the document side of the join is balanced.
    """
    used = features(docs, key, markup.images(F.col(text))).select(*key, "url")
    found = key_join(used, bodies.withColumn("__found", F.lit(True)), ["url"], "left")
    src_id = refs.id_from_path(F.col("url"))
    cid = refs.compound_id(*[F.col(k) for k in key], src_id)
    where = refs.pointer(storage, cid, F.col("content"))
    meta = refs.image_meta(F.col("width"), F.col("height"), src_id)
    return found.select(
        *[F.col(k).alias(i) for k, i in zip(key, inherit_ids, strict=True)],
        src_id.alias("src_id"),
        F.when(F.col("__found"), refs.object_ref(F.col("content"), F.col("content_type"), where, meta)).alias("image"),
    )
