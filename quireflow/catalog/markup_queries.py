"""Markdown features over a corpus derived from the documents, one block per text line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.catalog.registry import query, table
from quireflow.functions import markup
from quireflow.functions.languages import PLAIN
from quireflow.operators import markup as jobs
from quireflow.specs import Storage

# Removed from the texts first, so that all markup is the markup put in here.
STRIPPED = "`[]|#<>$*_~!&{}\"/\\"

_I = "CAST(i AS STRING)"
_NL = "chr(10)"
# One block per line, in SQL that Spark and DuckDB read alike; the kind goes by (doc_id + i) % 12.
BLOCK = f"""CASE (doc_id + i) % 12
  WHEN 0 THEN CASE WHEN i % 2 = 1 THEN '### ' || line || ' {{#sec-' || {_I} || '}}' ELSE '## ' || line END
  WHEN 1 THEN '```' || CASE doc_id % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'Python {{title="T1", linenos start=3}}'
       WHEN 2 THEN 'golang' WHEN 3 THEN 'unknownlang' ELSE 'c++' END || {_NL} || line || {_NL} || '# not a heading' || {_NL} || '```'
  WHEN 2 THEN line || ' [link](https://h.example/' || CAST(doc_id AS STRING) || ' "tt") and `[no](x)`'
  WHEN 3 THEN '![' || line || ' ' || {_I} || '](./img/' || CAST(i % 5 AS STRING) || '.png "t' || CAST(i % 2 AS STRING) || '")'
  WHEN 4 THEN line || '[^f' || CAST(i % 3 AS STRING) || ']'
  WHEN 5 THEN '> [!' || CASE i % 5 WHEN 0 THEN 'NOTE' WHEN 1 THEN 'TIP' WHEN 2 THEN 'IMPORTANT' WHEN 3 THEN 'WARNING' ELSE 'CAUTION' END
       || ']' || {_NL} || '> ' || line || {_NL} || '> more'
  WHEN 6 THEN line || {_NL} || {_NL} || 'https://h.example/p/' || CAST(i % 40 AS STRING)
  WHEN 7 THEN '| a | b |' || {_NL} || '|:--|--:|' || {_NL} || '| ' || {_I} || ' | ' || line
  WHEN 8 THEN '- [x] ' || line || ' ' || {_I} || {_NL} || '- [ ] open'
  WHEN 9 THEN line || ' $x+' || {_I} || '$ here' || {_NL} || '$$' || {_NL} || 'y = ' || {_I} || {_NL} || '$$'
  WHEN 10 THEN line || ' <mail@example.com>, [[Wiki ' || {_I} || ']], <https://auto.example/' || {_I}
       || '> and [broken][nope' || {_I} || '], [known][ref]'
  ELSE line END"""

TAIL = '\n\n[^f0]: note zero\n\n[^f1]: note one\n\n[ref]: https://ref.example/ "Ref"\n'


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, md): every document's whole text, turned into Markdown inside its row."""
    lines = F.transform(
        F.split(F.translate("text", STRIPPED, ""), "\n"),
        lambda s: F.trim(F.concat(F.lit("Line "), s)),
    )
    docs = table(spark, sf_dir, "documents", costly=True).select("doc_id", lines.alias("lines"))
    blocks = F.expr(f"transform(lines, (line, i) -> {BLOCK})")
    return docs.select("doc_id", F.concat(F.array_join(blocks, "\n\n"), F.lit(TAIL)).alias("md"))


CORPUS_SQL = f"""WITH
 src AS (SELECT doc_id, string_split(translate(text, '{STRIPPED}', ''), chr(10)) AS ls FROM documents),
 ln AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, trim('Line ' || unnest(ls)) AS line FROM src),
 blk AS (SELECT doc_id, i, line, (doc_id + i) % 12 AS r, {BLOCK} AS block FROM ln)"""


def _seq(order: str = "i") -> str:
    return f"(row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - 1)::INTEGER AS seq"


def _feature(spark: SparkSession, sf_dir: str, array) -> DataFrame:
    return jobs.features(corpus(spark, sf_dir), ["doc_id"], array(F.col("md")))


@query(
    "md_sections",
    CORPUS_SQL
    + """,
 num AS (SELECT *, sum(CASE WHEN r = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq FROM blk),
 body AS (SELECT doc_id, seq, string_agg(block, chr(10) || chr(10) ORDER BY i) AS content FROM num WHERE r <> 0 GROUP BY ALL)
  SELECT n.doc_id, n.seq::INTEGER AS seq, CASE WHEN i % 2 = 1 THEN 3 ELSE 2 END AS level,
         CASE WHEN i % 2 = 1 THEN 'sec-' || i ELSE regexp_replace(line, '\\s', '-', 'g') END AS id,
         line AS title, coalesce(content, '') AS content
  FROM num n LEFT JOIN body b ON b.doc_id = n.doc_id AND b.seq = n.seq WHERE r = 0""",
)
def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature(spark, sf_dir, markup.sections)


@query(
    "md_slug",
    CORPUS_SQL
    + f"""
  SELECT doc_id, {_seq()}, line AS title, regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}-]', '', 'g') AS slug FROM blk WHERE r = 0""",
)
def md_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feature(spark, sf_dir, markup.sections)
    return rows.select("doc_id", "seq", "title", markup.slug(F.col("title")).alias("slug"))


_LANG = "['rust', 'Python', 'golang', 'unknownlang', 'c'][doc_id % 5 + 1]"


@query(
    "md_codeblocks",
    CORPUS_SQL
    + f"""
  SELECT doc_id, {_seq()}, {_LANG} AS lang, CASE WHEN doc_id % 5 = 1 THEN 'T1' END AS title,
         2 AS lines, line || chr(10) || '# not a heading' || chr(10) AS code FROM blk WHERE r = 1""",
)
def md_codeblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.code_blocks(corpus(spark, sf_dir), ["doc_id"], "md")


@query(
    "md_fence_meta",
    CORPUS_SQL
    + f""",
 b AS (SELECT doc_id, {_seq()}, {_LANG} AS lang FROM blk WHERE r = 1)
  SELECT doc_id, seq, lang, unnest(['title', 'linenos', 'start']) AS attr, unnest(['T1', 'true', '3']) AS value,
         unnest(['string', 'boolean', 'integer']) AS type FROM b WHERE doc_id % 5 = 1""",
)
def md_fence_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.fence_meta(corpus(spark, sf_dir), ["doc_id"], "md")


@query(
    "md_lang_usage",
    CORPUS_SQL
    + f"""
  SELECT ['rust', 'python', 'go', '{PLAIN}', 'c'][doc_id % 5 + 1] AS language, count(*) AS blocks, (2 * count(*))::BIGINT AS lines
  FROM blk WHERE r = 1 GROUP BY ALL""",
)
def md_lang_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.language_usage(corpus(spark, sf_dir), "md")


@query(
    "md_alerts",
    CORPUS_SQL
    + f"""
  SELECT doc_id, {_seq()}, ['note', 'tip', 'important', 'warning', 'caution'][i % 5 + 1] AS kind,
         line || chr(10) || 'more' AS text FROM blk WHERE r = 5""",
)
def md_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature(spark, sf_dir, markup.alerts)


_NOTES_SQL = (
    CORPUS_SQL
    + f""",
 refs AS (SELECT doc_id, i, {_seq()}, 'f' || (i % 3) AS id FROM blk WHERE r = 4),
 known AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM refs WHERE id IN ('f0', 'f1')),
 numbers AS (SELECT doc_id, id, min(n) AS number FROM known GROUP BY ALL),
 defs AS (SELECT doc_id, unnest([0, 1]) AS seq, unnest(['f0', 'f1']) AS id, unnest(['note zero', 'note one']) AS content FROM documents),
 notes AS (
  SELECT d.doc_id, 'definition' AS part, d.seq, d.id, number, content
  FROM defs d LEFT JOIN numbers n ON n.doc_id = d.doc_id AND n.id = d.id
  UNION ALL
  SELECT r.doc_id, 'reference', r.seq, r.id, number,
         CASE r.id WHEN 'f0' THEN 'note zero' WHEN 'f1' THEN 'note one' END
  FROM refs r LEFT JOIN numbers n ON n.doc_id = r.doc_id AND n.id = r.id)"""
)


@query(
    "md_footnotes",
    _NOTES_SQL
    + " SELECT doc_id, part, seq, id, coalesce(number::VARCHAR, '') AS number, content FROM notes",
)
def md_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feature(spark, sf_dir, markup.footnotes)
    return rows.withColumn("number", F.coalesce(F.col("number").cast("string"), F.lit("")))


@query("win_footnote_number", _NOTES_SQL + " SELECT doc_id, id, number FROM numbers")
def win_footnote_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feature(spark, sf_dir, markup.footnotes)
    numbered = (F.col("part") == "definition") & F.col("number").isNotNull()
    return rows.where(numbered).select("doc_id", "id", F.col("number").cast("bigint").alias("number"))


@query(
    "md_images",
    CORPUS_SQL
    + """
  SELECT doc_id, './img/' || (i % 5) || '.png' AS url, 't' || (min(i) % 2) AS title, arg_min(line, i) || ' ' || min(i) AS alt
  FROM blk WHERE r = 3 GROUP BY doc_id, i % 5""",
)
def md_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature(spark, sf_dir, markup.images)


_PAGE = "'https://h.example/p/' || (i % 40)"

_LINKS_SQL = (
    CORPUS_SQL
    + f""",
 raw AS (
  SELECT doc_id, i, 0 AS o, 'https://h.example/' || doc_id AS href, 'tt' AS title, 'link' AS text, 'normal' AS kind FROM blk WHERE r = 2
  UNION ALL SELECT doc_id, i, 0, {_PAGE}, {_PAGE}, {_PAGE}, 'autolink' FROM blk WHERE r = 6
  UNION ALL SELECT doc_id, i, 0, 'mail@example.com', '', 'mail@example.com', 'email' FROM blk WHERE r = 10
  UNION ALL SELECT doc_id, i, 1, 'Wiki ' || i, '', 'Wiki ' || i, 'wikilink' FROM blk WHERE r = 10
  UNION ALL SELECT doc_id, i, 2, 'https://auto.example/' || i, '', 'https://auto.example/' || i, 'autolink' FROM blk WHERE r = 10
  UNION ALL SELECT doc_id, i, 3, '', '', 'broken', 'broken' FROM blk WHERE r = 10
  UNION ALL SELECT doc_id, i, 4, 'https://ref.example/', 'Ref', 'known', 'normal' FROM blk WHERE r = 10)"""
)


@query("md_links", _LINKS_SQL + f" SELECT doc_id, {_seq('i, o')}, href, title, text, kind FROM raw")
def md_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature(spark, sf_dir, markup.links)


@query(
    "agg_distinct_links",
    _LINKS_SQL + " SELECT doc_id, href, count(*) AS uses FROM raw WHERE kind <> 'broken' GROUP BY ALL",
)
def agg_distinct_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct link targets per document, with their number of uses."""
    rows = _feature(spark, sf_dir, markup.links).where(F.col("kind") != "broken")
    return rows.groupBy("doc_id", "href").agg(F.count(F.lit(1)).alias("uses"))


@query("md_isolated_links", CORPUS_SQL + f" SELECT DISTINCT doc_id, {_PAGE} AS url FROM blk WHERE r = 6")
def md_isolated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.isolated_links(corpus(spark, sf_dir), ["doc_id"], "md")


@query(
    "md_plain_text",
    CORPUS_SQL
    + """,
 plain AS (SELECT doc_id, i, CASE r
   WHEN 1 THEN line || chr(10) || '# not a heading'
   WHEN 2 THEN line || ' link and [no](x)'
   WHEN 3 THEN line || ' ' || i
   WHEN 5 THEN line || chr(10) || 'more'
   WHEN 6 THEN line || chr(10) || 'https://h.example/p/' || (i % 40)
   WHEN 7 THEN 'a b' || chr(10) || i || ' ' || line
   WHEN 8 THEN line || ' ' || i || chr(10) || 'open'
   WHEN 9 THEN line || ' x+' || i || ' here' || chr(10) || 'y = ' || i
   WHEN 10 THEN line || ' mail@example.com, Wiki ' || i || ', https://auto.example/' || i || ' and broken, known'
   ELSE line END AS t FROM blk)
  SELECT doc_id, string_agg(t, chr(10) ORDER BY i) AS plain FROM plain GROUP BY doc_id""",
)
def md_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", markup.plain_text(F.col("md")).alias("plain"))


@query(
    "md_table_cells",
    CORPUS_SQL
    + f""",
 t AS (SELECT doc_id, i, line, {_seq().replace("AS seq", "AS table_seq")} FROM blk WHERE r = 7)
  SELECT doc_id, table_seq, unnest([0, 0, 1, 1])::INTEGER AS row, unnest([0, 1, 0, 1])::INTEGER AS col,
         unnest(['left', 'right', 'left', 'right']) AS align, unnest(['a', 'b', CAST(i AS VARCHAR), line]) AS text FROM t""",
)
def md_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature(spark, sf_dir, markup.table_cells)


@query(
    "md_tasks",
    CORPUS_SQL
    + """,
 t AS (SELECT doc_id, i, 0 AS o, true AS checked, line || ' ' || i AS text FROM blk WHERE r = 8
       UNION ALL SELECT doc_id, i, 1, false, 'open' FROM blk WHERE r = 8)"""
    + f" SELECT doc_id, {_seq('i, o')}, checked, text FROM t",
)
def md_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature(spark, sf_dir, markup.tasks)


@query(
    "md_math",
    CORPUS_SQL
    + """,
 t AS (SELECT doc_id, i, 0 AS o, false AS display, 'x+' || i AS source FROM blk WHERE r = 9
       UNION ALL SELECT doc_id, i, 1, true, 'y = ' || i FROM blk WHERE r = 9)"""
    + f" SELECT doc_id, {_seq('i, o')}, display, source FROM t",
)
def md_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature(spark, sf_dir, markup.math_spans)


def _escape_sql(column: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;"), ("/", "&#x2F;")):
        column = f"replace({column}, '{char}', '{entity}')"
    return column


@query("md_escape", f"SELECT page_id, {_escape_sql('html')} AS escaped FROM pages")
def md_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", markup.html_escape(F.col("html")).alias("escaped")
    )


_IMAGE_STORE = Storage("r2", bucket="assets", prefix="doc/images")


@query(
    "nst_image_table",
    CORPUS_SQL
    + """,
 bodies AS (SELECT item_id AS n, text AS c FROM benchmark WHERE item_id <> 3),
 used AS (SELECT DISTINCT doc_id, i % 5 AS n, 'img/' || (i % 5) || '.png' AS src_id FROM blk WHERE r = 3)
  SELECT u.doc_id, src_id,
         sha256(sha256(c) || 'r2' || 'assets' || 'doc/images/' || u.doc_id || '/' || src_id) AS hash,
         coalesce(strlen(c), -1) AS size, CASE WHEN b.n IS NOT NULL THEN 'r2://assets/doc/images/' || u.doc_id || '/' || src_id END AS uri,
         coalesce(b.n + 10, -1)::INTEGER AS width, CASE WHEN b.n IS NOT NULL THEN 20 ELSE -1 END AS height
  FROM used u LEFT JOIN bodies b ON b.n = u.n""",
)
def nst_image_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images found by URL among bodies taken from the benchmark rows; one that no body was found for has no reference."""
    bodies = table(spark, sf_dir, "benchmark").where("item_id <> 3").select(
        F.concat(F.lit("./img/"), F.col("item_id").cast("string"), F.lit(".png")).alias("url"),
        F.col("text").alias("content"),
        F.lit("image/png").alias("content_type"),
        (F.col("item_id") + 10).alias("width"),
        F.lit(20).alias("height"),
    )
    rows = jobs.image_table(corpus(spark, sf_dir), ["doc_id"], ["doc_id"], "md", bodies, _IMAGE_STORE)
    image = F.col("image")
    p = image["pointer"]
    return rows.select(
        "doc_id",
        "src_id",
        image["hash"].alias("hash"),
        F.coalesce(image["size"], F.lit(-1)).alias("size"),
        F.concat(F.lit("r2://"), p["bucket"], F.lit("/"), p["key"]).alias("uri"),
        F.coalesce(image["meta"]["width"], F.lit(-1)).alias("width"),
        F.coalesce(image["meta"]["height"], F.lit(-1)).alias("height"),
    )


