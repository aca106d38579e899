"""Digests, keys, pointers, object inventory, upload and delete sets, store writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.catalog.registry import query, table
from quireflow.catalog.snapshots import RUN_TS
from quireflow.functions import hashing, refs
from quireflow.functions.mime import with_content_type
from quireflow.operators import digests, objects
from quireflow.plans import lifecycle
from quireflow.specs import CollectionSpec, Field, Storage, TableSpec

# One object per document, page and benchmark row; its store goes by id % 4.
SOURCES = {
    "documents": ("doc_id", "text", "text/plain"),
    "pages": ("page_id", "html", "text/html"),
    "benchmark": ("item_id", "text", "text/plain"),
}


def _stores(name: str) -> list[Storage]:
    return [
        Storage("r2", bucket="assets", prefix=name),
        Storage("kv", namespace=f"ns_{name}"),
        Storage("asset", dir=f"public/{name}"),
        Storage("inline"),
    ]


def _spec(name: str) -> TableSpec:
    return CollectionSpec(
        name=name,
        table=name,
        schema=(("id", Field("id")), ("file", Field("file", storage=Storage("inline")))),
    ).tables()[name]


SPECS = {name: _spec(name) for name in SOURCES}


def _by_store(id_: Column, arms: list[Column]) -> Column:
    kind = id_ % 4
    return F.when(kind == 0, arms[0]).when(kind == 1, arms[1]).when(kind == 2, arms[2]).otherwise(arms[3])


def _rows(spark: SparkSession, sf_dir: str, name: str, side: str) -> DataFrame:
    """(id, content, file) of one source in the stored or the incoming snapshot."""
    id_name, text, content_type = SOURCES[name]
    id_ = F.col(id_name)
    rows = table(spark, sf_dir, name, costly=name != "benchmark").where(id_ % (10 if side == "old" else 11) != 0)
    content = F.col(text)
    if side == "new":
        content = F.when(id_ % 7 == 0, F.concat(content, F.lit("!"))).otherwise(content)
    cid = id_.cast("string")
    where = _by_store(id_, [refs.pointer(s, cid, content) for s in _stores(name)])
    placed = rows.select(cid.alias("id"), content.alias("content"), where.alias("where"))
    ref = refs.object_ref(F.col("content"), F.lit(content_type), F.col("where"))
    return placed.select("id", "content", ref.alias("file"))


def snapshot(spark: SparkSession, sf_dir: str, side: str) -> dict[str, DataFrame]:
    return {name: _rows(spark, sf_dir, name, side).select("id", "file") for name in SOURCES}


def located(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Every object with its entry, location and payload."""
    parts = [
        _rows(spark, sf_dir, name, side).select(
            F.lit(i).alias("seq"),
            F.concat(F.lit(f"{name}/"), F.col("id")).alias("entry"),
            F.col("content"),
            F.col("file.hash").alias("hash"),
            F.col("file.size").alias("size"),
            F.col("file.content_type").alias("content_type"),
            F.col("file.pointer").alias("pointer"),
        )
        for i, name in enumerate(SOURCES)
    ]
    return objects.with_location(reduce(DataFrame.unionByName, parts))


def _side_sql(side: str) -> str:
    modulus = 10 if side == "old" else 11
    content = "c" if side == "old" else "CASE WHEN id % 7 = 0 THEN c || '!' ELSE c END"
    return f"""
{side}_loc AS (
  SELECT seq, t, id, t || '/' || id AS entry, {content} AS content, content_type,
         ['r2', 'kv', 'asset', 'inline'][id % 4 + 1] AS type,
         CASE WHEN id % 4 = 0 THEN 'assets' END AS bucket,
         CASE WHEN id % 4 = 1 THEN 'ns_' || t END AS namespace,
         CASE id % 4 WHEN 0 THEN t || '/' || id WHEN 1 THEN CAST(id AS VARCHAR) END AS key,
         CASE WHEN id % 4 = 2 THEN 'public/' || t || '/' || id END AS path
  FROM obj WHERE id % {modulus} <> 0),
{side}_obj AS (
  SELECT *, strlen(content) AS size,
         sha256(sha256(content) || type || coalesce(bucket, '') || coalesce(namespace, '')
                || coalesce(key, '') || coalesce(path, '')) AS hash,
         CASE type WHEN 'r2' THEN 'r2://' || bucket || '/' || key WHEN 'kv' THEN 'kv://' || namespace || '/' || key
                   WHEN 'asset' THEN 'asset://' || path ELSE 'inline://...' END AS uri
  FROM {side}_loc)"""


OBJ_SQL = (
    """WITH obj AS (
  SELECT 0 AS seq, 'documents' AS t, doc_id AS id, text AS c, 'text/plain' AS content_type FROM documents
  UNION ALL SELECT 1, 'pages', page_id, html, 'text/html' FROM pages
  UNION ALL SELECT 2, 'benchmark', item_id, text, 'text/plain' FROM benchmark),"""
    + _side_sql("old")
    + ","
    + _side_sql("new")
)


@query(
    "prj_compound_id",
    "SELECT o_custkey || '/' || o_orderkey AS compound_id, o_orderstatus FROM orders",
)
def prj_compound_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        refs.compound_id(F.col("o_custkey"), F.col("o_orderkey")).alias("compound_id"), "o_orderstatus"
    )


@query(
    "prj_storage_key",
    """
  SELECT o_orderkey, 'posts/' || o_custkey || '/' || o_orderkey AS r2_key,
         o_custkey || '/' || o_orderkey || '/' || lower(o_orderstatus) AS kv_key,
         'public/posts/' || o_custkey || '/' || o_orderkey AS asset_path FROM orders""",
)
def prj_storage_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    cid = refs.compound_id(F.col("o_custkey"), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        refs.storage_key(Storage("r2", bucket="b", prefix="posts"), cid).alias("r2_key"),
        refs.storage_key(Storage("kv", namespace="n"), cid, F.lower("o_orderstatus")).alias("kv_key"),
        refs.storage_key(Storage("asset", dir="public/posts"), cid).alias("asset_path"),
    )


@query("prj_pointer_uri", OBJ_SQL + " SELECT entry, type, uri FROM new_obj")
def prj_pointer_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir, "new").select("entry", "type", "uri")


@query(
    "prj_object_ref",
    OBJ_SQL
    + " SELECT entry, hash, size, content_type, type, bucket, namespace, key, path FROM new_obj",
)
def prj_object_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir, "new").select(
        "entry", "hash", "size", "content_type", "type", "bucket", "namespace", "key", "path"
    )


@query(
    "prj_path_id",
    """
  SELECT page_id, 'img/' || page_id || CASE WHEN page_id % 3 = 0 THEN '/' ELSE '.png' END AS path,
         CASE page_id % 4 WHEN 3 THEN './' ELSE '' END || 'img/' || page_id
           || CASE page_id % 3 WHEN 0 THEN '' ELSE '.png' END AS derived_id
  FROM pages""",
)
def prj_path_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources start with ``./``, ``/``, ``.//./`` or nothing and may end in ``/``."""
    n = F.col("page_id")
    head = F.when(n % 4 == 0, "./").when(n % 4 == 1, "/").when(n % 4 == 3, ".//./").otherwise("")
    path = F.concat(F.lit("img/"), n.cast("string"), F.when(n % 3 == 0, "/").otherwise(".png"))
    return table(spark, sf_dir, "pages").select(
        "page_id", path.alias("path"), refs.id_from_path(F.concat(head, path)).alias("derived_id")
    )


@query("prj_url_id", "SELECT page_id, url_encode(url || ' ~*é+(x)') AS derived_id FROM pages")
def prj_url_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", refs.id_from_url(F.concat("url", F.lit(" ~*é+(x)"))).alias("derived_id")
    )


@query(
    "prj_mime",
    """
  SELECT p_partkey, replace(p_name, ' ', '_') || ['.png', '.JPG', '.md', '.bin', '', '.tar.gz'][p_partkey % 6 + 1] AS path,
         ['image/png', 'image/jpeg', 'text/markdown', 'application/octet-stream',
          'application/octet-stream', 'application/gzip'][p_partkey % 6 + 1] AS content_type
  FROM part""",
)
def prj_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*[F.lit(e) for e in (".png", ".JPG", ".md", ".bin", "", ".tar.gz")])
    path = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.get(ends, F.col("p_partkey") % 6))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return with_content_type(rows, F.col("path"))


@query(
    "prj_inline_base64",
    """
  SELECT doc_id, doc_id % 2 = 0 AS base64,
         CASE WHEN doc_id % 2 = 0 THEN to_base64(encode(text)) ELSE text END AS content FROM documents""",
)
def prj_inline_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    inline, binary = Storage("inline"), F.col("doc_id") % 2 == 0
    text, none = F.col("text"), F.lit("")
    where = F.when(binary, refs.pointer(inline, none, text.cast("binary"), text=False)).otherwise(
        refs.pointer(inline, none, text)
    )
    return (
        table(spark, sf_dir, "documents", costly=True)
        .select("doc_id", where.alias("p"))
        .select("doc_id", "p.base64", "p.content")
    )


@query(
    "prj_svg_embed",
    """
  SELECT page_id, strlen('<svg>' || html || '</svg>') AS size,
         CASE WHEN strlen('<svg>' || html || '</svg>') < 4096 THEN 'embed' ELSE 'store' END AS placement FROM pages""",
)
def prj_svg_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    svg = F.concat(F.lit("<svg>"), F.col("html"), F.lit("</svg>"))
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", F.octet_length(svg).cast("bigint").alias("size"))
        .withColumn("placement", refs.embeds_svg(F.col("size"), 4096))
    )


_CONFIG = "glob: documents/*"


@query("hsh_document", f"SELECT doc_id, sha256('{_CONFIG}' || text) AS doc_hash FROM documents")
def hsh_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", hashing.document_hash(_CONFIG, F.col("text")).alias("doc_hash")
    )


@query(
    "hsh_row",
    f"""
  SELECT doc_id, sha256(sha256('{_CONFIG}' || text) || chr(10) || 'id' || chr(10) || 'file' || chr(10)
      || least(sha256(lang), sha256(source)) || chr(10) || greatest(sha256(lang), sha256(source))) AS hash
  FROM documents""",
)
def hsh_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.array(hashing.digest(F.col("lang")), hashing.digest(F.col("source")))
    doc_hash = hashing.document_hash(_CONFIG, F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", hashing.row_hash(SPECS["documents"], doc_hash, files).alias("hash")
    )


@query("hsh_object", OBJ_SQL + " SELECT entry, sha256(content) AS content_hash, hash FROM old_obj")
def hsh_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir, "old").select(
        "entry", hashing.digest(F.col("content")).alias("content_hash"), "hash"
    )


@query(
    "hsh_short_unique",
    """
  WITH h AS (SELECT doc_id, source, sha256(doc_id || ':' || text) AS digest FROM documents),
  n AS (SELECT source, digest, lag(digest) OVER (PARTITION BY source ORDER BY digest) AS before FROM h),
  p AS (SELECT source, max(CASE WHEN before IS NULL THEN 0 WHEN before = digest THEN 64
          ELSE list_position(list_transform(range(1, 65), lambda i: substr(before, i, 1) = substr(digest, i, 1)), false) - 1
        END) + 1 AS short_len FROM n GROUP BY source)
  SELECT doc_id, source, short_len, substr(digest, 1, short_len) AS short FROM h JOIN p USING (source)""",
)
def hsh_short_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        hashing.digest(F.concat_ws(":", F.col("doc_id").cast("string"), "text")).alias("digest"),
    )
    return digests.with_short_digest(docs, "source", "digest").drop("digest")


@query("set_object_inventory", OBJ_SQL + " SELECT CAST(seq AS INTEGER) AS seq, hash, type, uri FROM old_obj")
def set_object_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects.inventory(spark, snapshot(spark, sf_dir, "old"), SPECS)
    return objects.with_location(found).select("seq", "hash", "type", "uri")


@query(
    "agg_last_by_hash",
    OBJ_SQL
    + """
  SELECT hash, max(entry) AS entry, any_value(uri) AS uri FROM (
    SELECT hash, entry, uri, rank() OVER (PARTITION BY hash ORDER BY seq DESC, entry DESC) AS r FROM old_obj)
  WHERE r = 1 GROUP BY hash""",
)
def agg_last_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = located(spark, sf_dir, "old").select("hash", "seq", "entry", "uri")
    return objects.last_by_hash(rows, ["seq", "entry"]).drop("seq")


@query(
    "obj_to_upload",
    OBJ_SQL + " SELECT entry, uri, hash FROM new_obj WHERE type <> 'inline' AND hash NOT IN (SELECT hash FROM old_obj)",
)
def obj_to_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = objects.route(located(spark, sf_dir, "new")).select("entry", "uri", "hash")
    return objects.to_upload(uploads, located(spark, sf_dir, "old"))


@query(
    "obj_partition",
    OBJ_SQL + " SELECT entry, uri, hash, hash IN (SELECT hash FROM old_obj) AS skipped FROM new_obj WHERE type <> 'inline'",
)
def obj_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = objects.route(located(spark, sf_dir, "new")).select("entry", "uri", "hash")
    return objects.partition_uploads(uploads, located(spark, sf_dir, "old"))


@query(
    "obj_disappeared",
    OBJ_SQL
    + """
  SELECT entry, uri, hash FROM old_obj
  WHERE type <> 'inline' AND hash NOT IN (SELECT hash FROM new_obj) AND uri NOT IN (SELECT uri FROM new_obj)""",
)
def obj_disappeared(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = objects.route(located(spark, sf_dir, "new")).select("hash", "uri")
    old = objects.route(located(spark, sf_dir, "old")).select("entry", "uri", "hash")
    return objects.disappeared(old, new, new)


@query(
    "rte_multiplex",
    OBJ_SQL
    + """
  SELECT type AS store, bucket, namespace, key, path, content_type, size, hash FROM new_obj WHERE type <> 'inline'""",
)
def rte_multiplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.route(located(spark, sf_dir, "new")).select(
        "store", "bucket", "namespace", "key", "path", "content_type", "size", "hash"
    )


@query(
    "obj_lifecycle",
    OBJ_SQL
    + """,
 ops AS (
  SELECT CASE WHEN hash IN (SELECT hash FROM old_obj) THEN 'skip' ELSE 'upload' END AS action,
         type AS store, uri, hash FROM new_obj
  UNION ALL
  SELECT 'delete', type, uri, hash FROM old_obj
  WHERE hash NOT IN (SELECT hash FROM new_obj) AND uri NOT IN (SELECT uri FROM new_obj))
  SELECT * FROM ops WHERE store <> 'inline'""",
)
def obj_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (snapshot(spark, sf_dir, side) for side in ("old", "new"))
    return lifecycle.object_actions(spark, old, new, SPECS)


@query(
    "snk_object_overlay",
    OBJ_SQL
    + """
  SELECT coalesce(n.type, o.type) AS store, coalesce(n.uri, o.uri) AS uri, coalesce(n.hash, o.hash) AS hash,
         coalesce(n.size, o.size) AS size
  FROM (SELECT * FROM old_obj WHERE type <> 'inline') o
  FULL JOIN (SELECT * FROM new_obj WHERE type <> 'inline') n ON o.uri = n.uri""",
)
def snk_object_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("store", "uri", "hash", "size")
    stored, puts = (
        objects.route(located(spark, sf_dir, side)).select(*cols) for side in ("old", "new")
    )
    return objects.overlay(stored, puts, ["store", "uri"])


@query(
    "snk_object_delete",
    OBJ_SQL
    + """
  SELECT type AS store, uri, hash FROM old_obj WHERE type <> 'inline' AND NOT (
    hash NOT IN (SELECT hash FROM new_obj) AND uri NOT IN (SELECT uri FROM new_obj))""",
)
def snk_object_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = objects.route(located(spark, sf_dir, "new")).select("hash", "uri")
    old = objects.route(located(spark, sf_dir, "old")).select("store", "uri", "hash")
    gone = objects.disappeared(old, new, new)
    return objects.delete(old, gone, ["store", "uri"])


_NAMESPACES = [f"ns_{name}" for name in SOURCES]


@query(
    "snk_kv_batches",
    OBJ_SQL
    + """,
 kv AS (SELECT namespace, key, t <> 'documents' AS base64,
          CASE WHEN t <> 'documents' THEN to_base64(encode(content)) ELSE content END AS value
        FROM new_obj WHERE type = 'kv'),
 sized AS (SELECT *, 'm' || length(key) AS metadata, strlen(key) + strlen(value) + strlen('m' || length(key)) AS size FROM kv),
 started AS (
  SELECT *, size <= 20000 AS small,
         coalesce(sum(CASE WHEN size <= 20000 THEN size END) OVER w, 0) AS bytes,
         count(CASE WHEN size <= 20000 THEN 1 END) OVER w AS n, count(CASE WHEN size > 20000 THEN 1 END) OVER w AS large
  FROM sized WINDOW w AS (PARTITION BY namespace ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 placed AS (SELECT *, CASE WHEN small THEN bytes // 20000 + n // 50 ELSE -1 - large END::BIGINT AS batch FROM started)
  SELECT namespace, batch, count(*) AS n_pairs, string_agg(key, ',' ORDER BY key) AS keys,
         sha256(string_agg(key || '=' || value || '=' || base64 || '=' || length(key) || '=' || metadata, chr(10) ORDER BY key)) AS payload_hash
  FROM placed GROUP BY namespace, batch""",
)
def snk_kv_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts go as text, pages and benchmark rows as bytes in base64; at most 50 pairs and 40,000 bytes to a batch."""
    binary = ~F.col("entry").startswith("documents/")
    value = F.when(binary, refs.base64_text(F.col("content").cast("binary"))).otherwise(F.col("content"))
    pairs = (
        located(spark, sf_dir, "new")
        .where(F.col("type") == "kv")
        .select("namespace", "key", value.alias("value"), binary.alias("base64"))
        .withColumn("expiration_ttl", F.length("key"))
        .withColumn("metadata", F.concat(F.lit("m"), F.length("key")))
    )
    parts = ("key", "value", "base64", "expiration_ttl", "metadata")
    text = F.transform("pairs", lambda p: F.concat_ws("=", *[p[c].cast("string") for c in parts]))
    return objects.kv_batches(pairs, target=50, max_bytes=40_000).select(
        "namespace",
        "batch",
        F.size("pairs").cast("bigint").alias("n_pairs"),
        F.array_join("pairs.key", ",").alias("keys"),
        hashing.digest(F.array_join(text, "\n")).alias("payload_hash"),
    )
