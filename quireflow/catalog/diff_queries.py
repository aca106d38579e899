"""Snapshot diff, joins on keys, cleanup, cascade, ancestor touch, whole sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.catalog import snapshots as S
from quireflow.catalog.registry import query, table
from quireflow.operators import checks, dedup, diff, joins
from quireflow.plans import apply, sync
from quireflow.session import work_dir
from quireflow.sinks.snapshots import SnapshotStore

RUN = S.RUN_TS


def _pair(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    return S.stored(spark, sf_dir, name), S.incoming(spark, sf_dir, name)


def _rendered(df: DataFrame) -> DataFrame:
    for name in ("created_at", "updated_at"):
        if name in df.columns:
            df = df.withColumn(name, diff.render_timestamp(F.col(name)))
    return df


@query(
    "ups_change_feed",
    f"{S.with_sql('lines', feeds=True)} SELECT * FROM feed_lines",
)
def ups_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.change_feed(*_pair(spark, sf_dir, "lines"), S.LINES)


_LINE_STATE = f"""
  SELECT coalesce(o.l_custkey, n.l_custkey) AS l_custkey,
         coalesce(o.l_orderkey, n.l_orderkey) AS l_orderkey,
         coalesce(o.l_linenumber, n.l_linenumber) AS l_linenumber,
         CASE WHEN f.op IN ('insert', 'update') THEN n.l_partkey ELSE o.l_partkey END AS l_partkey,
         CASE WHEN f.op IN ('insert', 'update') THEN n.l_quantity ELSE o.l_quantity END AS l_quantity,
         CASE WHEN f.op IN ('insert', 'update') THEN n.l_returnflag ELSE o.l_returnflag END AS l_returnflag,
         CASE WHEN f.op = 'insert' THEN {S.RUN_AT} ELSE {S.STORED_AT} END AS created_at,
         CASE WHEN f.op IN ('insert', 'update') THEN {S.RUN_AT} ELSE {S.STORED_AT} END AS updated_at
  FROM feed_lines f
  LEFT JOIN old_lines o USING (l_custkey, l_orderkey, l_linenumber)
  LEFT JOIN new_lines n USING (l_custkey, l_orderkey, l_linenumber)"""


@query("ups_upsert", S.with_sql("lines", feeds=True) + _LINE_STATE)
def ups_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(diff.upsert(*_pair(spark, sf_dir, "lines"), S.LINES, RUN))


@query(
    "ups_id_only",
    S.with_sql("orders")
    + f"""
  SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey,
         coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
         CASE WHEN o.o_orderkey IS NULL THEN {S.RUN_AT} ELSE {S.STORED_AT} END AS created_at
  FROM old_orders o FULL JOIN new_orders n ON o.o_custkey = n.o_custkey AND o.o_orderkey = n.o_orderkey""",
)
def ups_id_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = S.TableSpec(
        name="order_ids",
        fields=(("o_orderkey", S.Field("id")), ("created_at", S.Field("created_at"))),
        id_name="o_orderkey",
        inherit_ids=("o_custkey",),
        created_at="created_at",
    )
    old, new = _pair(spark, sf_dir, "orders")
    old = old.select("o_custkey", "o_orderkey", "created_at")
    return _rendered(diff.upsert(old, new, spec, RUN))


@query(
    "ups_timestamps",
    S.with_sql("orders", feeds=True)
    + f"""
  SELECT o_custkey, o_orderkey, op,
         CASE WHEN op = 'insert' THEN {S.RUN_AT} ELSE {S.STORED_AT} END AS created_at,
         CASE WHEN op IN ('insert', 'update') THEN {S.RUN_AT} ELSE {S.STORED_AT} END AS updated_at
  FROM feed_orders WHERE op <> 'delete'""",
)
def ups_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _pair(spark, sf_dir, "orders")
    state, now = diff.synced(old, new, S.ORDERS, RUN), diff.run_timestamp(RUN)
    op = (
        F.when(F.col("created_at") == now, diff.INSERT)
        .when(F.col("updated_at") == now, diff.UPDATE)
        .otherwise(diff.UNCHANGED)
    )
    return _rendered(
        state.select("o_custkey", "o_orderkey", op.alias("op"), "created_at", "updated_at")
    )


@query(
    "del_cleanup",
    S.with_sql("lines")
    + """
  SELECT * FROM old_lines o WHERE EXISTS (
    SELECT 1 FROM new_lines n
    WHERE n.l_custkey = o.l_custkey AND n.l_orderkey = o.l_orderkey AND n.l_linenumber = o.l_linenumber)""",
)
def del_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _pair(spark, sf_dir, "lines")
    return diff.cleanup(old.drop("created_at", "updated_at"), new, S.LINES)


@query(
    "del_cascade",
    S.with_sql("customers", "orders", "lines")
    + """,
 kept_c AS (SELECT c_custkey FROM old_customers WHERE c_custkey IN (SELECT c_custkey FROM new_customers)),
 kept_o AS (SELECT * FROM old_orders WHERE o_custkey IN (SELECT c_custkey FROM kept_c)),
 kept_l AS (SELECT l.* FROM old_lines l JOIN kept_o o ON o.o_custkey = l.l_custkey AND o.o_orderkey = l.l_orderkey)
  SELECT 'customers' AS table_name, CAST(c_custkey AS VARCHAR) AS key FROM kept_c
  UNION ALL SELECT 'orders', o_custkey || '/' || o_orderkey FROM kept_o
  UNION ALL SELECT 'lines', l_custkey || '/' || l_orderkey || '/' || l_linenumber FROM kept_l""",
)
def del_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = {name: S.stored(spark, sf_dir, name) for name in S.SPECS}
    old["customers"] = diff.cleanup(
        old["customers"], S.incoming(spark, sf_dir, "customers"), S.CUSTOMERS
    )
    left = diff.cascade(old, S.SPECS)
    parts = [
        df.select(F.lit(name).alias("table_name"), diff.key_text(S.SPECS[name]).alias("key"))
        for name, df in left.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_TOUCH_SQL = """,
 dirty_o AS (SELECT o_custkey, o_orderkey FROM feed_orders WHERE op <> 'unchanged'),
 dirty_l AS (SELECT l_custkey, l_orderkey FROM feed_lines WHERE op <> 'unchanged'),
 touch_o AS (SELECT DISTINCT l_custkey AS o_custkey, l_orderkey AS o_orderkey FROM dirty_l),
 touch_c AS (SELECT o_custkey AS c_custkey FROM dirty_o UNION SELECT l_custkey FROM dirty_l)"""


@query(
    "tch_ancestors",
    S.with_sql("customers", "orders", "lines", feeds=True)
    + _TOUCH_SQL
    + f"""
  SELECT 'customers' AS table_name, CAST(c_custkey AS VARCHAR) AS key, {S.STORED_AT} AS created_at,
         CASE WHEN c_custkey IN (SELECT c_custkey FROM touch_c) THEN {S.RUN_AT} ELSE {S.STORED_AT} END AS updated_at
  FROM old_customers
  UNION ALL
  SELECT 'orders', o.o_custkey || '/' || o.o_orderkey, {S.STORED_AT},
         CASE WHEN t.o_orderkey IS NOT NULL THEN {S.RUN_AT} ELSE {S.STORED_AT} END
  FROM old_orders o LEFT JOIN touch_o t ON t.o_custkey = o.o_custkey AND t.o_orderkey = o.o_orderkey""",
)
def tch_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = S.both(spark, sf_dir)
    touched = sync.touched(old, new, S.SPECS)
    parts = []
    for name in ("customers", "orders"):
        spec = S.SPECS[name]
        state = diff.touch(old[name], touched[name], spec, RUN)
        parts.append(
            state.select(
                F.lit(name).alias("table_name"),
                diff.key_text(spec).alias("key"),
                "created_at",
                "updated_at",
            )
        )
    return _rendered(parts[0].unionByName(parts[1]))


@query(
    "tch_incoming",
    S.with_sql("lines", feeds=True)
    + """
  SELECT DISTINCT l_custkey AS o_custkey, l_orderkey AS o_orderkey FROM feed_lines
  WHERE op IN ('insert', 'update')""",
)
def tch_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = diff.incoming_changes(*_pair(spark, sf_dir, "lines"), S.LINES)
    return joins.distinct_keys(changed, S.LINES.inherit_ids, S.ORDERS.pk)


@query(
    "tch_removed",
    S.with_sql("lines", feeds=True)
    + """
  SELECT DISTINCT l_custkey AS o_custkey, l_orderkey AS o_orderkey FROM feed_lines WHERE op = 'delete'""",
)
def tch_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = diff.removed_rows(*_pair(spark, sf_dir, "lines"), S.LINES)
    return joins.distinct_keys(removed, S.LINES.inherit_ids, S.ORDERS.pk)


@query(
    "sync_plan",
    S.with_sql("customers", "orders", "lines", feeds=True)
    + _TOUCH_SQL
    + """,
 ops AS (
  SELECT 'customers' AS table_name, CAST(f.c_custkey AS VARCHAR) AS key,
         CASE WHEN f.op = 'unchanged' AND t.c_custkey IS NOT NULL THEN 'touch' ELSE f.op END AS op
  FROM feed_customers f LEFT JOIN touch_c t ON t.c_custkey = f.c_custkey
  UNION ALL
  SELECT 'orders', f.o_custkey || '/' || f.o_orderkey,
         CASE WHEN f.op = 'unchanged' AND t.o_orderkey IS NOT NULL THEN 'touch' ELSE f.op END
  FROM feed_orders f LEFT JOIN touch_o t ON t.o_custkey = f.o_custkey AND t.o_orderkey = f.o_orderkey
  UNION ALL
  SELECT 'lines', l_custkey || '/' || l_orderkey || '/' || l_linenumber, op FROM feed_lines)
  SELECT * FROM ops WHERE op <> 'unchanged'""",
)
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_changes(*S.both(spark, sf_dir), S.SPECS)


def _state_sql(name: str, key: str, touched: str) -> str:
    """Rows of a table after the run, with its data columns as one text."""
    spec = S.SPECS[name]
    match = " AND ".join(f"f.{c} = n.{c}" for c in spec.pk)
    data = " || '|' || ".join(f"coalesce(n.{c}::VARCHAR, '-')" for c in spec.data_cols)
    return f"""
  SELECT '{name}' AS table_name, {key} AS key, md5({data}) AS data,
         CASE WHEN f.op = 'insert' THEN {S.RUN_AT} ELSE {S.STORED_AT} END AS created_at,
         CASE WHEN f.op IN ('insert', 'update') OR {touched} THEN {S.RUN_AT} ELSE {S.STORED_AT} END AS updated_at
  FROM new_{name} n JOIN feed_{name} f ON {match}"""


@query(
    "sync_apply",
    S.with_sql("customers", "orders", "lines", feeds=True)
    + _TOUCH_SQL
    + _state_sql("customers", "n.c_custkey::VARCHAR", "n.c_custkey IN (SELECT c_custkey FROM touch_c)")
    + " UNION ALL"
    + _state_sql("orders", "n.o_custkey || '/' || n.o_orderkey", "(n.o_custkey, n.o_orderkey) IN (SELECT (o_custkey, o_orderkey) FROM touch_o)")
    + " UNION ALL"
    + _state_sql("lines", "n.l_custkey || '/' || n.l_orderkey || '/' || n.l_linenumber", "false"),
)
def sync_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs against a store: the stored tables come in, then the incoming ones; the tables as read back."""
    store = SnapshotStore(spark, work_dir(spark, "store"))
    old, new = S.both(spark, sf_dir)
    apply.sync_store(store, S.SPECS, old, S.OLD_TS)
    apply.sync_store(store, S.SPECS, new, RUN)
    view, parts = store.at(), []
    for name, spec in S.SPECS.items():
        data = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in spec.data_cols]).cast("binary"))
        rows = view.read(name).select(F.lit(name).alias("table_name"), diff.key_text(spec).alias("key"), data.alias("data"), "created_at", "updated_at")
        parts.append(_rendered(rows))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "ups_bucket_feed",
    S.with_sql("lines", feeds=True)
    + " SELECT l_custkey, l_orderkey, l_linenumber, op FROM feed_lines WHERE op <> 'unchanged' AND l_custkey % 500 = 1",
)
def ups_bucket_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only lines of few customers change; they are stored in buckets by customer, and the other buckets are not read again."""
    store = SnapshotStore(spark, work_dir(spark, "store"), buckets=64)
    old, new = _pair(spark, sf_dir, "lines")
    run = store.begin()
    run.replace("lines", old, S.LINES.pk, by=["l_custkey"], ignore=["created_at", "updated_at"])
    run.commit()
    few = F.col("l_custkey") % 500 == 1
    incoming = new.where(few).unionByName(old.where(~few).select(*new.columns))
    return apply.changed_rows(store, S.LINES, incoming)


@query(
    "snk_full_refresh",
    S.with_sql("orders")
    + f"""
  SELECT *, {S.RUN_AT} AS created_at, {S.RUN_AT} AS updated_at FROM new_orders""",
)
def snk_full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _pair(spark, sf_dir, "orders")
    return _rendered(diff.synced(diff.empty_like(old), new, S.ORDERS, RUN))


@query(
    "win_last_wins",
    f"WITH {S.LINE_U_SQL} SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate) FROM line_u",
)
def win_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.last_wins(table(spark, sf_dir, "lineitem", costly=True), S.LINE_KEY, S.LINE_ORDER)
    return rows.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


@query(
    "jn_anti_key",
    S.with_sql("orders")
    + """
  SELECT o_custkey, o_orderkey FROM old_orders o WHERE NOT EXISTS (
    SELECT 1 FROM new_orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderkey = o.o_orderkey)""",
)
def jn_anti_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _pair(spark, sf_dir, "orders")
    return joins.anti_by_key(old, new, S.ORDERS.pk).select(*S.ORDERS.pk)


@query(
    "jn_nullsafe_anti",
    S.with_sql("orders")
    + """
  SELECT * FROM new_orders n WHERE NOT EXISTS (
    SELECT 1 FROM old_orders o WHERE n.o_custkey = o.o_custkey AND n.o_orderkey = o.o_orderkey
      AND n.o_orderstatus IS NOT DISTINCT FROM o.o_orderstatus
      AND n.o_totalprice IS NOT DISTINCT FROM o.o_totalprice
      AND n.o_orderpriority IS NOT DISTINCT FROM o.o_orderpriority)""",
)
def jn_nullsafe_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.incoming_changes(*_pair(spark, sf_dir, "orders"), S.ORDERS)


@query(
    "jn_prefix_semi",
    S.with_sql("customers", "lines", feeds=True)
    + """
  SELECT c_custkey FROM old_customers WHERE c_custkey IN (SELECT l_custkey FROM feed_lines WHERE op = 'insert')""",
)
def jn_prefix_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _pair(spark, sf_dir, "lines")
    added = joins.anti_by_key(new, old, S.LINES.pk)
    customers = S.stored(spark, sf_dir, "customers")
    return diff.key_prefix_semi(customers, S.CUSTOMERS, added, S.LINES).select("c_custkey")


@query(
    "jn_or_exists",
    S.with_sql("customers", "orders", "lines", feeds=True)
    + """
  SELECT c_custkey FROM old_customers c
  WHERE EXISTS (SELECT 1 FROM feed_orders f WHERE f.o_custkey = c.c_custkey AND f.op <> 'unchanged')
     OR EXISTS (SELECT 1 FROM feed_lines f WHERE f.l_custkey = c.c_custkey AND f.op <> 'unchanged')""",
)
def jn_or_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = S.both(spark, sf_dir)
    keys = sync.touched(old, new, S.SPECS)["customers"]
    return joins.semi_by_key(old["customers"], keys, S.CUSTOMERS.pk).select("c_custkey")


@query(
    "chk_pk_dups",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def chk_pk_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_keys(table(spark, sf_dir, "lineitem"), S.LINE_KEY)


@query(
    "chk_fk_orphans",
    """
  SELECT l_partkey AS key, count(*) AS n_rows FROM lineitem
  WHERE l_partkey NOT IN (SELECT doc_id FROM labels) GROUP BY ALL""",
)
def chk_fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines hold to parts; against the sparse keys of the labels many of them are orphans."""
    lines, labels = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "labels")
    orphans = checks.orphan_keys(lines, labels, ["l_partkey"], ["doc_id"])
    return orphans.withColumnRenamed("l_partkey", "key")


_ORDER_CHECK_SQL = """
  SELECT 'o_orderkey' AS column_name, 'not_null' AS rule, count(*) FILTER (o_orderkey IS NULL) AS violations FROM new_orders
  UNION ALL SELECT 'o_custkey', 'not_null', count(*) FILTER (o_custkey IS NULL) FROM new_orders
  UNION ALL SELECT 'o_orderstatus', 'not_null', count(*) FILTER (o_orderstatus IS NULL) FROM new_orders
  UNION ALL SELECT 'o_orderpriority', 'not_null', count(*) FILTER (o_orderpriority IS NULL) FROM new_orders
  UNION ALL SELECT 'is_open', 'boolean', count(*) FILTER (o_orderkey % 9 NOT IN (0, 1)) FROM new_orders
  UNION ALL SELECT 'due', 'iso_date', count(*) FILTER (o_orderkey % 12 = 0) FROM new_orders
  UNION ALL SELECT 'file', 'object_reference', count(*) FILTER (o_orderkey % 15 = 0) FROM new_orders"""


@query("chk_contract", S.with_sql("orders") + _ORDER_CHECK_SQL)
def chk_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows as the relational side keeps them: flags as 0/1, dates and references as text."""
    key = F.col("o_orderkey")
    rows = S.incoming(spark, sf_dir, "orders").select(
        "*",
        (key % 9).alias("is_open"),
        F.when(key % 12 == 0, "2024-13-01").otherwise("2024-01-31").alias("due"),
        F.when(key % 15 == 0, "{}")
        .otherwise(
            F.format_string(
                '{"hash":"%s","size":1,"content_type":"text/plain","meta":null,'
                '"pointer":{"type":"kv","namespace":"n","key":"%s"}}',
                F.sha2(key.cast("string"), 256),
                key.cast("string"),
            )
        )
        .alias("file"),
    )
    rules = {
        "o_orderkey": "not_null",
        "o_custkey": "not_null",
        "o_orderstatus": "not_null",
        "o_orderpriority": "not_null",
        "is_open": "boolean",
        "due": "iso_date",
        "file": "object_reference",
    }
    return checks.contract(rows, rules)
