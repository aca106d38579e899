"""Typed validation, on one JSON record per order with faults injected by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.catalog.registry import query, table
from quireflow.functions import typed
from quireflow.operators import nested, report, validate
from quireflow.plans.apply import run_batch
from quireflow.plans.compile import Compiled, compile_records, upload_log
from quireflow.session import settle, work_dir
from quireflow.sinks.snapshots import SnapshotStore
from quireflow.sources.tables import TASK_ROWS, spread
from quireflow.specs import CollectionSpec, Field, MarkdownImages, Storage

POSTS = CollectionSpec(
    name="posts",
    table="posts",
    schema=(
        ("id", Field("id")),
        ("hash", Field("hash")),
        ("title", Field("string", required=True)),
        ("qty", Field("integer")),
        ("price", Field("real")),
        ("open", Field("boolean")),
        ("due", Field("date")),
        ("at", Field("datetime")),
        ("created", Field("created_at")),
        ("tags", Field("records", table="tags", inherit_ids=("post_id",), schema=(("tag", Field("id")),))),
        (
            "notes",
            Field(
                "records",
                table="notes",
                inherit_ids=("post_id",),
                schema=(("note_id", Field("id")), ("body", Field("string", required=True))),
            ),
        ),
    ),
)

SPECS = POSTS.tables()
ROOT = SPECS["posts"]

# The record as text, in SQL that Spark and DuckDB read alike; k is the order's key.
_K = "CAST(k AS STRING)"
RAW = f"""'{{' ||
  CASE WHEN k % 17 = 0 THEN '' WHEN k % 19 = 0 THEN '"id":' || {_K} || ',' WHEN k % 23 = 0 THEN '"id":null,'
       ELSE '"id":"o' || {_K} || '",' END ||
  CASE WHEN k % 16 = 0 THEN '"hash":"abc",' ELSE '' END ||
  CASE WHEN k % 5 = 0 THEN '"title":42,' WHEN k % 7 = 0 THEN '"title":null,' WHEN k % 11 = 0 THEN ''
       ELSE '"title":"t' || {_K} || '",' END ||
  CASE WHEN k % 6 = 0 THEN '"qty":' || {_K} || '.5,' WHEN k % 9 = 0 THEN '"qty":true,'
       WHEN k % 10 = 0 THEN '"qty":9223372036854775808,' WHEN k % 13 = 0 THEN '' ELSE '"qty":' || {_K} || ',' END ||
  CASE WHEN k % 4 = 0 THEN '"price":' || {_K} || ',' WHEN k % 14 = 0 THEN '"price":1e3,'
       WHEN k % 21 = 0 THEN '"price":"1.5",' ELSE '"price":' || {_K} || '.25,' END ||
  CASE WHEN k % 3 = 0 THEN '"open":"true",' WHEN k % 8 = 1 THEN '"open":1,' ELSE '"open":true,' END ||
  CASE WHEN k % 12 = 0 THEN '"due":"2024-13-01",' WHEN k % 15 = 0 THEN '"due":"2024-1-5",' WHEN k % 22 = 0 THEN '"due":5,'
       WHEN k % 26 = 0 THEN '"due":"2024-01-05x",' ELSE '"due":"2024-02-29",' END ||
  CASE WHEN k % 12 = 1 THEN '"at":"2024-01-01 10:00:00",' WHEN k % 13 = 0 THEN '"at":"2024-01-01T25:00:00",'
       WHEN k % 14 = 5 THEN '"at":"2024-01-01T10:00:00Z",' ELSE '"at":"2024-01-01T10:00:00",' END ||
  CASE WHEN k % 18 = 0 THEN '"tags":"x",' WHEN k % 21 = 0 THEN '"tags":["a",1],' WHEN k % 25 = 0 THEN ''
       ELSE '"tags":["a","b{{}}"],' END ||
  CASE WHEN k % 20 = 0 THEN '"notes":["bare"],' WHEN k % 27 = 0 THEN '"notes":[{{"note_id":"n0"}},{{"note_id":"n1","body":7}}],'
       ELSE '"notes":[{{"note_id":"n0","body":"b' || {_K} || '"}}],' END ||
  '"created":"never","extra":[1]}}'"""

REC_SQL = f"WITH rec AS (SELECT o_orderkey AS k, {RAW} AS r FROM (SELECT o_orderkey, o_orderkey AS k FROM orders))"


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, raw): the faulty records as JSON text."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return spread(keys, "k", task_rows=TASK_ROWS).select("k", F.expr(RAW).alias("raw"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records(spark, sf_dir).select("k", typed.parse_record(F.col("raw")).alias("record"))


def _checked(name: str, text_of=None):
    """Query body: (k, value, code) of one field for every record."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        field = ROOT.field(name)
        bound = typed.bind_field(F.col("record"), name, field, SPECS)
        rows = records(spark, sf_dir).select("k", bound.alias("b"))
        error = typed.field_error(F.col("b"), name, field, F.lit("x"))
        value = typed.field_value(F.col("b"), field)
        value = text_of(value) if text_of else value
        code = error["code"]
        return rows.select("k", F.when(code.isNull(), value).alias("value"), code.alias("code"))

    return run


def _check_sql(name: str, fits: str, value: str, required: bool = False, parsed: str | None = None,
               bad: str = "") -> str:
    missing = "WHEN jt IS NULL THEN 'MissingField'" if required else ""
    broken = f"WHEN jt IS NOT NULL AND ({parsed}) IS NULL THEN '{bad}'" if parsed else ""
    return f"""{REC_SQL},
 f AS (SELECT k, json_type(r, '$.{name}') AS jt, json_extract_string(r, '$.{name}') AS s FROM rec),
 c AS (SELECT *, CASE {missing} WHEN jt IS NOT NULL AND NOT ({fits}) THEN 'TypeMismatch' {broken} END AS code FROM f)
  SELECT k, CASE WHEN code IS NULL THEN {value} END AS value, code FROM c"""


query("val_id", _check_sql("id", "jt = 'VARCHAR'", "s", required=True))(_checked("id"))
query("val_string", _check_sql("title", "jt = 'VARCHAR'", "s", required=True))(_checked("title"))
query(
    "val_integer",
    _check_sql("qty", "jt IN ('BIGINT', 'UBIGINT') AND TRY_CAST(s AS BIGINT) IS NOT NULL", "CAST(TRY_CAST(s AS BIGINT) AS VARCHAR)"),
)(_checked("qty", lambda v: v.cast("string")))
query("val_real", _check_sql("price", "jt = 'DOUBLE'", "TRY_CAST(s AS DOUBLE)"))(_checked("price"))
query("val_boolean", _check_sql("open", "jt = 'BOOLEAN'", "s"))(_checked("open", lambda v: v.cast("string")))

_DATE_SQL = "CASE WHEN regexp_full_match(s, '\\d{1,4}-\\d{1,2}-\\d{1,2}') THEN TRY_CAST(s AS DATE) END"
_DATETIME_SQL = (
    "CASE WHEN regexp_full_match(s, '\\d{1,4}-\\d{1,2}-\\d{1,2}T\\d{1,2}:\\d{1,2}:\\d{1,2}(\\.\\d+)?')"
    " THEN TRY_CAST(s AS TIMESTAMP) END"
)
query(
    "val_date",
    _check_sql("due", "jt = 'VARCHAR'", f"strftime({_DATE_SQL}, '%Y-%m-%d')", parsed=_DATE_SQL, bad="InvalidDate"),
)(_checked("due", lambda v: F.date_format(v, "yyyy-MM-dd")))
query(
    "val_datetime",
    _check_sql(
        "at",
        "jt = 'VARCHAR'",
        f"strftime({_DATETIME_SQL}, '%Y-%m-%dT%H:%M:%S')",
        parsed=_DATETIME_SQL,
        bad="InvalidDatetime",
    ),
)(_checked("at", lambda v: F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss")))


@query(
    "val_computed",
    f"{REC_SQL} SELECT k, CASE WHEN json_type(r, '$.hash') IS NOT NULL THEN 'FoundComputedField' END AS code FROM rec",
)
def val_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = ROOT.field("hash")
    bound = typed.bind_field(F.col("record"), "hash", field, SPECS)
    error = typed.field_error(F.col("b"), "hash", field, F.lit("x"))
    return records(spark, sf_dir).select("k", bound.alias("b")).select("k", error["code"].alias("code"))


_NESTED_SQL = """
 tag_e AS (SELECT k, unnest(json_extract(r, '$.tags[*]')) AS e FROM rec),
 note_e AS (SELECT k, unnest(json_extract(r, '$.notes[*]')) AS e FROM rec),
 nested_errors AS (
  SELECT k, 'tags' AS field, 'TypeMismatch' AS code, 'array' AS expected, json_extract(r, '$.tags')::VARCHAR AS got, NULL AS sub
  FROM rec WHERE json_type(r, '$.tags') <> 'ARRAY'
  UNION ALL SELECT k, 'notes', 'TypeMismatch', 'array', json_extract(r, '$.notes')::VARCHAR, NULL
  FROM rec WHERE json_type(r, '$.notes') <> 'ARRAY'
  UNION ALL SELECT k, 'tags', 'TypeMismatch', 'object', e::VARCHAR, NULL FROM tag_e WHERE json_type(e) NOT IN ('VARCHAR', 'OBJECT')
  UNION ALL SELECT k, 'notes', 'TypeMismatch', 'object', e::VARCHAR, NULL FROM note_e WHERE json_type(e) <> 'OBJECT'
  UNION ALL SELECT k, 'body', 'MissingField', NULL, NULL, json_extract_string(e, '$.note_id') FROM note_e
  WHERE json_type(e) = 'OBJECT' AND json_type(e, '$.body') IS NULL
  UNION ALL SELECT k, 'body', 'TypeMismatch', 'string', json_extract(e, '$.body')::VARCHAR, json_extract_string(e, '$.note_id') FROM note_e
  WHERE json_type(e) = 'OBJECT' AND json_type(e, '$.body') <> 'VARCHAR')"""


@query("val_records", f"{REC_SQL},{_NESTED_SQL} SELECT k, field, code, expected, got FROM nested_errors")
def val_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.with_errors(records(spark, sf_dir), POSTS)
    return (
        validate.dead_letters(checked, "k")
        .where(F.col("field").isin("tags", "notes", "body"))
        .select(F.col("source_entry").alias("k"), "field", "code", "expected", "got")
    )


_FIELD_ERRORS_SQL = " UNION ALL ".join(
    f"""SELECT k, '{name}' AS field, 'TypeMismatch' AS code, '{expected}' AS expected,
       json_extract(r, '$.{name}')::VARCHAR AS got, NULL AS sub
  FROM (SELECT *, json_type(r, '$.{name}') AS jt, json_extract_string(r, '$.{name}') AS s FROM rec)
  WHERE jt IS NOT NULL AND NOT ({fits})"""
    for name, expected, fits in (
        ("id", "string", "jt = 'VARCHAR'"),
        ("title", "string", "jt = 'VARCHAR'"),
        ("qty", "integer", "jt IN ('BIGINT', 'UBIGINT') AND TRY_CAST(s AS BIGINT) IS NOT NULL"),
        ("price", "real", "jt = 'DOUBLE'"),
        ("open", "boolean", "jt = 'BOOLEAN'"),
        ("due", "date", "jt = 'VARCHAR'"),
        ("at", "datetime", "jt = 'VARCHAR'"),
    )
)

ALL_ERRORS_SQL = f"""{REC_SQL},{_NESTED_SQL},
 errors AS (
  {_FIELD_ERRORS_SQL}
  UNION ALL SELECT k, 'id', 'MissingField', NULL, NULL, NULL FROM rec WHERE json_type(r, '$.id') IS NULL
  UNION ALL SELECT k, 'title', 'MissingField', NULL, NULL, NULL FROM rec WHERE json_type(r, '$.title') IS NULL
  UNION ALL SELECT k, 'hash', 'FoundComputedField', NULL, NULL, NULL FROM rec WHERE json_type(r, '$.hash') IS NOT NULL
  UNION ALL SELECT k, 'due', 'InvalidDate', NULL, s, NULL FROM (SELECT k, json_extract_string(r, '$.due') AS s FROM rec
    WHERE json_type(r, '$.due') = 'VARCHAR') WHERE ({_DATE_SQL}) IS NULL
  UNION ALL SELECT k, 'at', 'InvalidDatetime', NULL, s, NULL FROM (SELECT k, json_extract_string(r, '$.at') AS s FROM rec
    WHERE json_type(r, '$.at') = 'VARCHAR') WHERE ({_DATETIME_SQL}) IS NULL
  UNION ALL SELECT * FROM nested_errors)"""


@query(
    "val_dead_letter",
    ALL_ERRORS_SQL
    + """
  SELECT 'orders/' || e.k || '.json' AS source_entry,
         CASE WHEN json_type(r, '$.id') = 'VARCHAR' THEN json_extract_string(r, '$.id') ELSE '?' END
           || coalesce('/' || sub, '') AS id,
         field, code, expected, got
  FROM errors e JOIN rec ON rec.k = e.k""",
)
def val_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit("orders/"), F.col("k").cast("string"), F.lit(".json"))
    rows = records(spark, sf_dir).withColumn("source_entry", entry)
    return validate.dead_letters(validate.with_errors(rows, POSTS))


@query(
    "val_required",
    ALL_ERRORS_SQL
    + """
  SELECT json_extract_string(r, '$.id') AS id, json_extract_string(r, '$.title') AS title,
         json_extract_string(r, '$.qty') AS qty,
         TRY_CAST(json_extract_string(r, '$.price') AS DOUBLE) AS price,
         json_extract_string(r, '$.open') AS open,
         strftime(TRY_CAST(json_extract_string(r, '$.due') AS DATE), '%Y-%m-%d') AS due,
         array_to_string(json_extract_string(r, '$.tags[*]'), ',') AS tags
  FROM rec WHERE k NOT IN (SELECT k FROM errors)""",
)
def val_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without any error, cut to their declared, typed columns."""
    good = validate.accepted(validate.with_errors(records(spark, sf_dir), POSTS), POSTS)
    return good.select(
        "id",
        "title",
        F.col("qty").cast("string").alias("qty"),
        "price",
        F.col("open").cast("string").alias("open"),
        F.date_format("due", "yyyy-MM-dd").alias("due"),
        F.array_join(F.coalesce("tags", F.array()), ",").alias("tags"),
    )


@query(
    "val_to_tables",
    ALL_ERRORS_SQL
    + """,
 good AS (SELECT * FROM rec WHERE k NOT IN (SELECT k FROM errors))
  SELECT 'posts' AS table_name, 'o' || k AS key, json_extract_string(r, '$.title') AS body FROM good
  UNION ALL SELECT 'tags', 'o' || k || '/' || unnest(json_extract_string(r, '$.tags[*]')), NULL FROM good
  UNION ALL SELECT 'notes', 'o' || k || '/' || json_extract_string(n, '$.note_id'), json_extract_string(n, '$.body')
  FROM (SELECT k, unnest(json_extract(r, '$.notes[*]')) AS n FROM good)""",
)
def val_to_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validate, drop bad documents, write the rest once, flatten that to tables."""
    good = settle(validate.accepted(validate.with_errors(records(spark, sf_dir), POSTS), POSTS), "posts")
    body = {"posts": F.col("title"), "tags": F.expr("cast(null as string)"), "notes": F.col("body")}
    parts = [
        df.select(
            F.lit(name).alias("table_name"),
            F.concat_ws("/", *SPECS[name].pk).alias("key"),
            body[name].alias("body"),
        )
        for name, df in nested.flatten(good, POSTS).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "val_warnings",
    """
  WITH w AS (SELECT 'documents/' || doc_id AS entry, list_filter([
      CASE WHEN length(text) < 200 THEN 'short text' END,
      CASE WHEN text NOT LIKE '%' || chr(10) || '%' THEN 'single paragraph' END,
      CASE WHEN text LIKE '%' || chr(10) || chr(10) || '%' THEN 'empty paragraph' END],
      lambda m: m IS NOT NULL) AS ms FROM documents)
  SELECT entry, generate_subscripts(ms, 1)::INTEGER - 1 AS seq, unnest(ms) AS message FROM w""",
)
def val_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return validate.warnings(
        table(spark, sf_dir, "documents"),
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string")),
        {
            "short text": F.length(text) < 200,
            "single paragraph": ~text.contains("\n"),
            "empty paragraph": text.contains("\n\n"),
        },
    )


LOADED = CollectionSpec(
    name="leaflets",
    table="leaflets",
    schema=(
        ("id", Field("id")),
        ("enclosure", Field("file", storage=Storage("r2", bucket="b", prefix="enclosures"))),
        ("cover", Field("image", required=True, storage=Storage("r2", bucket="b", prefix="covers"))),
        (
            "body",
            Field(
                "markdown",
                storage=Storage("kv", namespace="bodies"),
                image=MarkdownImages(table="figures", inherit_ids=("leaflet",), embed_svg_threshold=0, storage=Storage("r2", bucket="b", prefix="figures")),
            ),
        ),
    ),
)

# A JSON value per field, in SQL that Spark and DuckDB read alike; some are no text, and some name a file that is not there.
_ENCLOSURE = """CASE doc_id % 5 WHEN 0 THEN '17' WHEN 1 THEN '"./files/' || CAST(doc_id % 9 AS STRING) || '.txt"'
  WHEN 2 THEN '"https://h.example/' || CAST(doc_id % 9 AS STRING) || '"' WHEN 3 THEN '"data:text/plain;base64,aGk="' END"""
_COVER = "CASE WHEN doc_id % 8 = 0 THEN 'true' ELSE '\"./img/' || CAST(doc_id % 6 AS STRING) || '.png\"' END"
_BODY_JSON = """CASE WHEN doc_id % 11 = 0 THEN '["no text"]' ELSE '"' || translate(text, chr(10) || chr(9) || chr(13) || '\\"[]!()', '   ')
  || ' ![f](./img/' || CAST(doc_id % 7 AS STRING) || '.png)"' END"""


_LOADED_SQL = f"""
  WITH d AS (SELECT doc_id, 'd' || doc_id AS id, {_ENCLOSURE} AS enclosure, {_COVER} AS cover, {_BODY_JSON} AS body FROM documents),
  wrong AS (
    SELECT id, 'enclosure' AS field, enclosure AS got FROM d WHERE doc_id % 5 = 0
    UNION ALL SELECT id, 'cover', cover FROM d WHERE doc_id % 8 = 0
    UNION ALL SELECT id, 'body', body FROM d WHERE doc_id % 11 = 0),
  good AS (SELECT * FROM d WHERE id NOT IN (SELECT id FROM wrong)),
  lost AS (
    SELECT id, 'enclosure' AS field, json_extract_string(enclosure, '$') AS got FROM good
    WHERE doc_id % 5 = 1 AND doc_id % 9 = 4 OR doc_id % 5 = 2 AND doc_id % 9 = 5
    UNION ALL SELECT id, 'cover', json_extract_string(cover, '$') FROM good WHERE doc_id % 6 = 3
    UNION ALL SELECT id, 'body', './img/' || (doc_id % 7) || '.png' FROM good WHERE doc_id % 7 = 3)"""


def _leaflets(spark: SparkSession, sf_dir: str) -> Compiled:
    docs = table(spark, sf_dir, "documents", costly=True)
    values = [F.concat(F.lit(f'"{n}":'), F.expr(v)) for n, v in (("enclosure", _ENCLOSURE), ("cover", _COVER), ("body", _BODY_JSON))]
    raw = F.concat(F.lit('{"id":"d'), F.col("doc_id"), F.lit('",'), F.concat_ws(",", *values), F.lit("}"))
    records = docs.select(
        F.concat(F.lit("/leaflets/d"), F.col("doc_id"), F.lit(".yaml")).alias(nested.SOURCE),
        F.lit("").alias(nested.DOC_HASH),
        typed.parse_record(raw).alias("record"),
        F.lit(None).cast("string").alias("decode_error"),
    )
    n = F.col("item_id")
    paths = F.array(
        F.when(n != 4, F.concat(F.lit("/leaflets/files/"), n, F.lit(".txt"))),
        F.when(n != 5, F.concat(F.lit("https://h.example/"), n)),
        F.when(n != 3, F.concat(F.lit("/leaflets/img/"), n, F.lit(".png"))),
    )
    bodies = table(spark, sf_dir, "benchmark").select(F.explode(F.array_compact(paths)).alias("path"), F.col("text").cast("binary").alias("content"))
    return compile_records(spark, LOADED, records, bodies.withColumn("length", F.octet_length("content").cast("bigint")))


@query(
    "val_load_failures",
    _LOADED_SQL
    + """
  SELECT id, field, 'TypeMismatch' AS code, got FROM wrong
  UNION ALL SELECT id, field, 'LoadFailed', got FROM lost
  UNION ALL SELECT id, '', 'Stored', CASE doc_id % 5 WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN 'text/plain' ELSE '' END
  FROM good WHERE id NOT IN (SELECT id FROM lost)""",
)
def val_load_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose file, image or Markdown image is no text or does not load are dead letters as a whole; the rest is stored."""
    done = _leaflets(spark, sf_dir)
    letters = done.dead_letters.select("id", "field", "code", "got")
    enclosed = F.coalesce(F.col("enclosure.content_type"), F.lit(""))
    stored = done.tables["leaflets"].select("id", F.lit("").alias("field"), F.lit("Stored").alias("code"), enclosed.alias("got"))
    return letters.unionByName(stored)


@query(
    "agg_batch_report",
    _LOADED_SQL
    + """,
  stored AS (SELECT * FROM d WHERE id NOT IN (SELECT id FROM wrong UNION SELECT id FROM lost))
  SELECT count(*) AS total, count(*) FILTER (id IN (SELECT id FROM stored)) AS successful, count(*) FILTER (id NOT IN (SELECT id FROM stored)) AS failed,
         (SELECT sum(CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 4 ELSE 3 END)::BIGINT FROM stored) AS uploads FROM d""",
)
def agg_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run against an empty store: documents done and failed, and their objects."""
    done = _leaflets(spark, sf_dir)
    store = SnapshotStore(spark, work_dir(spark, "store"), buckets=4)
    _, actions = run_batch(store, LOADED.tables(), done.tables, "2025-01-02 03:04:05")
    return report.run_report(done.entries, upload_log(done, actions))


@query(
    "src_json_project",
    """
  SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         json_type(props, '$.missing') IS NULL AS no_such_field FROM events""",
)
def src_json_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    record, field = F.col("record"), Field("integer")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "event_type", typed.parse_record(F.col("props")).alias("record"))
        .select(
            "event_id",
            "event_type",
            typed.field_value(typed.bind_field(record, "k", field, {}), field).alias("k"),
            typed.child(record, "missing").isNull().alias("no_such_field"),
        )
    )
