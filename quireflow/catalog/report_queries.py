"""Page metadata, link cards, look-ups, run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.catalog import object_queries as O
from quireflow.catalog.registry import query, table
from quireflow.functions import html
from quireflow.operators import links, objects, report, validate
from quireflow.operators import markup as jobs

# Head tags put into the pages by key, in SQL that Spark and DuckDB read alike.
HEAD = """'<head>' ||
  CASE WHEN page_id % 2 = 0 THEN '<meta property="og:title" content="OG ' || CAST(page_id AS STRING) || ' &amp; more">' ELSE '' END ||
  CASE WHEN page_id % 3 = 0 THEN '<meta content="TW ' || CAST(page_id AS STRING) || '" name="twitter:title"/>' ELSE '' END ||
  CASE WHEN page_id % 5 = 0 THEN '<meta name="description" content="About ' || CAST(page_id AS STRING) || '">' ELSE '' END ||
  CASE WHEN page_id % 7 = 0 THEN '<link rel="icon" href="/fav' || CAST(page_id AS STRING) || '.ico">'
       WHEN page_id % 11 = 0 THEN '<link rel="icon" href="https://cdn.example/f.ico">' ELSE '' END ||
  CASE WHEN page_id % 13 = 0 THEN '<!-- <meta property="og:title" content="hidden"> --><meta property="og:image" content="https://img.example/x.png">' ELSE '' END"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages", costly=True)
    return rows.withColumn("html", F.replace(F.col("html"), F.lit("<head>"), F.expr(HEAD)))


_META_SQL = """WITH meta AS (
  SELECT page_id, url,
    CASE WHEN page_id % 2 = 0 THEN 'OG ' || page_id || ' & more' END AS og_title,
    CASE WHEN page_id % 3 = 0 THEN 'TW ' || page_id END AS twitter_title,
    replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS title,
    CASE WHEN page_id % 5 = 0 THEN 'About ' || page_id END AS description,
    CASE WHEN page_id % 7 = 0 THEN '/fav' || page_id || '.ico' WHEN page_id % 11 = 0 THEN 'https://cdn.example/f.ico' END AS icon,
    CASE WHEN page_id % 13 = 0 THEN 'https://img.example/x.png' END AS og_image
  FROM pages)"""


@query(
    "lnk_page_meta",
    _META_SQL
    + """
  SELECT page_id, og_title, twitter_title, title, description, icon, og_image,
         (og_title IS NOT NULL)::INT + (twitter_title IS NOT NULL)::INT + (og_image IS NOT NULL)::INT AS n_props FROM meta""",
)
def lnk_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.col("m")
    rows = pages(spark, sf_dir).select("page_id", html.page_meta(F.col("html")).alias("m"))
    return rows.select(
        "page_id",
        html.prop(meta, "og:title").alias("og_title"),
        html.prop(meta, "twitter:title").alias("twitter_title"),
        "m.title",
        "m.description",
        "m.icon",
        html.prop(meta, "og:image").alias("og_image"),
        F.size("m.props").alias("n_props"),
    )


@query(
    "lnk_cards",
    _META_SQL
    + """,
 based AS (SELECT *, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host,
                  regexp_extract(url, '^(https?)://', 1) AS scheme FROM meta),
 faved AS (SELECT *, CASE WHEN icon LIKE 'http%' THEN icon WHEN icon IS NOT NULL THEN scheme || '://' || host || icon END AS favicon FROM based),
 cards AS (SELECT url, coalesce(og_title, twitter_title, title, host) AS title, coalesce(description, host) AS description,
                  coalesce(og_image, favicon) AS image, favicon FROM faved),
 best AS (SELECT * FROM cards QUALIFY row_number() OVER (PARTITION BY url
            ORDER BY title DESC, description DESC, image DESC NULLS LAST, favicon DESC NULLS LAST) = 1),
 used AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'https://nowhere.example/' || page_id % 10 FROM pages)
  SELECT u.page_id, u.url, b.url IS NOT NULL AS resolved, title, description, image, favicon
  FROM used u LEFT JOIN best b ON b.url = u.url""",
)
def lnk_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is quoted, by its bare URL, in one document, next to a URL nobody crawled."""
    rows = pages(spark, sf_dir)
    unknown = F.concat(F.lit("https://nowhere.example/"), (F.col("page_id") % 10).cast("string"))
    docs = rows.select(
        "page_id", F.concat_ws("\n\n", F.lit("See"), "url", F.lit("and"), unknown).alias("md")
    )
    found = jobs.isolated_links(docs, ["page_id"], "md")
    return links.link_cards(found, ["page_id"], links.page_cards(rows, "url", "html"))


@query(
    "jn_lookup_default",
    """
  SELECT d.doc_id, lang, source, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def jn_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of all documents; those without any get the default."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return links.lookup(rows, labels, ["doc_id"], {"quality": F.lit(-1), "toxic": F.lit(-1)})


# A run's log: one entry per document, page and benchmark row; every 13th one fails.
_FAILED = "id % 13 = 0"
_LOG_SQL = (
    O.OBJ_SQL
    + f""",
 entries AS (SELECT t || '/' || id AS entry, CASE WHEN {_FAILED} THEN 'failed' ELSE 'done' END AS status FROM obj),
 uploads AS (SELECT entry, uri, CASE WHEN hash IN (SELECT hash FROM old_obj) THEN 'skipped' ELSE 'uploaded' END AS status
             FROM new_obj WHERE type <> 'inline'),
 warnings AS (
  SELECT 'documents/' || doc_id AS entry, 'short text' AS message FROM documents WHERE length(text) < 200
  UNION ALL SELECT 'documents/' || doc_id, 'no paragraphs' FROM documents WHERE text NOT LIKE '%' || chr(10) || '%')"""
)


def _entry(name: str, id_: Column) -> Column:
    return F.concat(F.lit(f"{name}/"), id_.cast("string")).alias("entry")


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = []
    for name, (id_name, _, _) in O.SOURCES.items():
        failed = F.col(id_name) % 13 == 0
        status = F.when(failed, report.FAILED).otherwise(report.DONE).alias("status")
        parts.append(table(spark, sf_dir, name).select(_entry(name, F.col(id_name)), status))
    entries = parts[0].unionByName(parts[1]).unionByName(parts[2])
    new = objects.route(O.located(spark, sf_dir, "new")).select("entry", "uri", "hash")
    flagged = objects.partition_uploads(new, O.located(spark, sf_dir, "old"))
    what = F.when(F.col("skipped"), report.SKIPPED).otherwise(report.UPLOADED)
    uploads = flagged.select("entry", "uri", what.alias("status"))
    text = F.col("text")
    warnings = validate.warnings(
        table(spark, sf_dir, "documents"),
        _entry("documents", F.col("doc_id")),
        {"short text": F.length(text) < 200, "no paragraphs": ~text.contains("\n")},
    )
    return entries, uploads, warnings


@query(
    "agg_run_report",
    _LOG_SQL
    + """
  SELECT count(*) AS total, count(*) FILTER (status = 'done') AS successful, count(*) FILTER (status = 'failed') AS failed,
         (SELECT count(*) FROM uploads) AS uploads FROM entries""",
)
def agg_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, uploads, _ = _log(spark, sf_dir)
    return report.run_report(entries, uploads)


@query(
    "agg_entry_report",
    _LOG_SQL
    + """
  SELECT entry, status, (SELECT count(*) FROM warnings w WHERE w.entry = e.entry) AS n_warnings,
         (SELECT count(*) FROM uploads u WHERE u.entry = e.entry AND u.status = 'uploaded') AS n_uploaded,
         (SELECT count(*) FROM uploads u WHERE u.entry = e.entry AND u.status = 'skipped') AS n_skipped
  FROM entries e ORDER BY entry""",
)
def agg_entry_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.entry_report(*_log(spark, sf_dir))


@query(
    "srt_report_lines",
    _LOG_SQL
    + """
  SELECT entry, 0 AS part, status AS line FROM entries
  UNION ALL SELECT entry, 1, message FROM warnings
  UNION ALL SELECT entry, 2, status || ' ' || uri FROM uploads ORDER BY ALL""",
)
def srt_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_lines(*_log(spark, sf_dir))
