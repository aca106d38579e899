"""Nested records: documents of paragraphs of sentences, with tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.catalog.registry import query, table
from quireflow.functions.hashing import document_hash
from quireflow.operators import nested
from quireflow.operators.dedup import last_wins
from quireflow.specs import CollectionSpec, Field

LIBRARY = CollectionSpec(
    name="library",
    table="docs",
    config_text="library",
    schema=(
        ("id", Field("id")),
        ("hash", Field("hash")),
        ("lang", Field("string")),
        ("tags", Field("records", table="tags", inherit_ids=("doc_id",), schema=(("tag", Field("id")),))),
        (
            "paragraphs",
            Field(
                "records",
                table="paragraphs",
                inherit_ids=("doc_id",),
                schema=(
                    ("para_id", Field("id")),
                    ("hash", Field("hash")),
                    ("body", Field("string")),
                    (
                        "sentences",
                        Field(
                            "records",
                            table="sentences",
                            inherit_ids=("doc_id", "para_id"),
                            schema=(("sent_id", Field("id")), ("body", Field("string"))),
                        ),
                    ),
                ),
            ),
        ),
    ),
)

SPECS = LIBRARY.tables()


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested record per document, built inside the row: whole texts, no grouping."""

    def sentence(s: Column, j: Column) -> Column:
        return F.struct(F.concat(F.lit("s"), j.cast("string")).alias("sent_id"), s.alias("body"))

    def paragraph(line: Column, i: Column) -> Column:
        return F.struct(
            F.concat(F.lit("p"), i.cast("string")).alias("para_id"),
            line.alias("body"),
            F.transform(F.split(line, "\\. "), sentence).alias("sentences"),
        )

    return table(spark, sf_dir, "documents", costly=True).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        "lang",
        F.array("lang", "source").alias("tags"),
        F.transform(F.split("text", "\n"), paragraph).alias("paragraphs"),
        document_hash(LIBRARY.config_text, F.col("text")).alias(nested.DOC_HASH),
    )


_PARAS = """WITH
 lines AS (SELECT doc_id AS n, 'd' || doc_id AS doc_id, lang, source, text, string_split(text, chr(10)) AS ls FROM documents),
 paras AS (SELECT doc_id, lang, text, unnest(ls) AS body, generate_subscripts(ls, 1) - 1 AS i FROM lines),
 paragraphs AS (SELECT doc_id, 'p' || i AS para_id, i, text, body FROM paras),
 sents AS (SELECT doc_id, para_id, string_split(body, '. ') AS ss FROM paragraphs),
 sentences AS (SELECT doc_id, para_id, 's' || (generate_subscripts(ss, 1) - 1) AS sent_id, unnest(ss) AS body FROM sents)
"""


@query("nst_explode_children", _PARAS + "SELECT doc_id, para_id, body, i::INTEGER AS pos FROM paragraphs")
def nst_explode_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.explode_children(library(spark, sf_dir), ["id"], "paragraphs", SPECS["paragraphs"])
    return rows.select("doc_id", "para_id", "body", F.col(nested.POS).alias("pos"))


@query(
    "nst_scalar_children",
    "SELECT 'd' || doc_id AS doc_id, unnest([lang, source]) AS tag, unnest([0, 1])::INTEGER AS pos FROM documents",
)
def nst_scalar_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.explode_children(library(spark, sf_dir), ["id"], "tags", SPECS["tags"])
    return rows.select("doc_id", "tag", F.col(nested.POS).alias("pos"))


_FLAT = (
    _PARAS
    + """
  SELECT 'docs' AS table_name, 'd' || doc_id AS key, lang AS body,
         sha256(sha256('library' || text) || chr(10) || concat_ws(chr(10), 'id', 'hash', 'lang', 'tags', 'paragraphs')) AS hash FROM documents
  UNION ALL SELECT 'tags', 'd' || doc_id || '/' || unnest([lang, source]), NULL, NULL FROM documents
  UNION ALL SELECT 'paragraphs', doc_id || '/' || para_id, body,
         sha256(sha256('library' || text) || chr(10) || concat_ws(chr(10), 'para_id', 'hash', 'body', 'sentences')) FROM paragraphs
  UNION ALL SELECT 'sentences', doc_id || '/' || para_id || '/' || sent_id, body, NULL FROM sentences"""
)


def _stacked(tables: dict[str, DataFrame]) -> DataFrame:
    null = F.expr("cast(null as string)")
    body = {"docs": "lang", "paragraphs": "body", "sentences": "body"}
    parts = [
        df.select(
            F.lit(name).alias("table_name"),
            F.concat_ws("/", *SPECS[name].pk).alias("key"),
            (F.col(body[name]) if name in body else null).alias("body"),
            (F.col("hash") if "hash" in df.columns else null).alias("hash"),
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("nst_flatten_three_levels", _FLAT)
def nst_flatten_three_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stacked(nested.flatten(library(spark, sf_dir), LIBRARY))


@query("nst_merge_batches", _FLAT)
def nst_merge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents compiled in two batches give the same tables as in one."""
    docs = library(spark, sf_dir)
    odd = F.substring("id", -1, 1).isin("1", "3", "5", "7", "9")
    return _stacked(
        nested.merge([nested.flatten(docs.where(c), LIBRARY) for c in (odd, ~odd)])
    )


@query(
    "nst_renest",
    _PARAS
    + """,
 sized AS (SELECT *, ceil(count(*) OVER (PARTITION BY doc_id) / 20.0)::BIGINT AS parts FROM paragraphs),
 placed AS (SELECT *, ('0x' || substr(sha256(para_id), 1, 8))::BIGINT % parts AS part FROM sized),
 frag AS (SELECT doc_id, part, parts, count(*) AS n,
            string_agg(para_id || ':' || body, chr(10) ORDER BY i) AS children FROM placed GROUP BY ALL)
  SELECT l.doc_id AS id, coalesce(part, 0) AS part, coalesce(parts, 1) AS parts, coalesce(f.n, 0) AS n, l.lang, coalesce(children, '') AS children
  FROM lines l LEFT JOIN frag f ON f.doc_id = l.doc_id""",
)
def nst_renest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document as one JSON text per part of at most 20 or so paragraphs, read back here."""
    tables = nested.flatten(library(spark, sf_dir), LIBRARY)
    paras = tables["paragraphs"]
    docs = nested.renest(
        tables["docs"].select("id", "lang"),
        paras.drop("hash"),
        ["id"],
        SPECS["paragraphs"],
        "paragraphs",
        target=20,
    )
    text = F.to_json(F.struct("id", "lang", "paragraphs"), {"ignoreNullFields": "false"})
    back = F.from_json(
        text, "id string, lang string, paragraphs array<struct<para_id:string,body:string>>"
    )
    return docs.select("part", "parts", back.alias("d")).select(
        "d.id",
        "part",
        "parts",
        F.coalesce(F.size("d.paragraphs"), F.lit(0)).cast("bigint").alias("n"),
        "d.lang",
        F.coalesce(
            F.array_join(
                F.transform("d.paragraphs", lambda p: F.concat_ws(":", p["para_id"], p["body"])), "\n"
            ),
            F.lit(""),
        ).alias("children"),
    )


@query(
    "nst_last_wins_children",
    """
  SELECT 'd' || doc_id AS doc_id, source AS tag FROM documents
  UNION SELECT 'd' || doc_id, lang FROM documents""",
)
def nst_last_wins_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that repeat an id under one parent collapse to the last of them."""
    docs = library(spark, sf_dir).withColumn("tags", F.concat("tags", "tags"))
    tags = nested.explode_children(docs, ["id"], "tags", SPECS["tags"])
    return last_wins(tags.drop(nested.DOC_HASH), SPECS["tags"].pk, [nested.POS]).drop(nested.POS)
