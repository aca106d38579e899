"""Two snapshots of a three-level tree: customers, their orders, the order lines.

A row exists in a snapshot only if its ancestors do, as in nested documents. The
stored side leaves out keys divisible by 10, the incoming side keys divisible by
11; incoming rows change where the key is divisible by 7 and carry a null where it is
divisible by 13 (stored ones where it is divisible by 26), so null-safe comparison matters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.catalog.registry import table
from quireflow.operators.dedup import last_wins
from quireflow.operators.diff import run_timestamp
from quireflow.session import settle
from quireflow.specs import CollectionSpec, Field, TableSpec

RUN_TS = "2025-01-02 03:04:05.678"
OLD_TS = "2000-01-01 00:00:00"

TREE = CollectionSpec(
    name="sales",
    table="customers",
    schema=(
        ("c_custkey", Field("id")),
        ("c_name", Field("string", required=True)),
        ("c_acctbal", Field("real")),
        ("c_mktsegment", Field("string")),
        ("created_at", Field("created_at")),
        ("updated_at", Field("updated_at")),
        (
            "orders",
            Field(
                "records",
                table="orders",
                inherit_ids=("o_custkey",),
                schema=(
                    ("o_orderkey", Field("id")),
                    ("o_orderstatus", Field("string", required=True)),
                    ("o_totalprice", Field("real")),
                    ("o_orderpriority", Field("string")),
                    ("created_at", Field("created_at")),
                    ("updated_at", Field("updated_at")),
                    (
                        "lines",
                        Field(
                            "records",
                            table="lines",
                            inherit_ids=("l_custkey", "l_orderkey"),
                            schema=(
                                ("l_linenumber", Field("id")),
                                ("l_partkey", Field("integer", required=True)),
                                ("l_quantity", Field("real")),
                                ("l_returnflag", Field("string")),
                                ("created_at", Field("created_at")),
                                ("updated_at", Field("updated_at")),
                            ),
                        ),
                    ),
                ),
            ),
        ),
    ),
)

SPECS: dict[str, TableSpec] = TREE.tables()
CUSTOMERS, ORDERS, LINES = SPECS["customers"], SPECS["orders"], SPECS["lines"]

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = [
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]


@dataclass(frozen=True)
class Level:
    """How one table's snapshots are cut from its source rows."""

    spec: TableSpec
    key: Column
    ancestors: tuple[Column, ...]
    number: str
    text: str

    def stored(self, rows: DataFrame) -> DataFrame:
        kept = self._alive(rows, 10)
        text = F.when(self.key % 26 != 0, F.col(self.text))
        return self._shape(kept, F.col(self.number), text, run_timestamp(OLD_TS))

    def incoming(self, rows: DataFrame) -> DataFrame:
        kept = self._alive(rows, 11)
        number = F.when(self.key % 7 == 0, F.col(self.number) + 1).otherwise(F.col(self.number))
        text = F.when(self.key % 13 != 0, F.col(self.text))
        return self._shape(kept, number, text, None)

    def _alive(self, rows: DataFrame, modulus: int) -> DataFrame:
        for column in (*self.ancestors, self.key):
            rows = rows.where(column % modulus != 0)
        return rows

    def _shape(self, rows: DataFrame, number: Column, text: Column, stamp: Column | None) -> DataFrame:
        swap = {self.number: number, self.text: text}
        names = [c for c in self.spec.columns if c not in ("created_at", "updated_at")]
        out = [swap.get(c, F.col(c)).alias(c) for c in names]
        if stamp is not None:
            out += [stamp.alias("created_at"), stamp.alias("updated_at")]
        return rows.select(*out)


def _levels() -> dict[str, Level]:
    c, o, l = F.col("c_custkey"), F.col("o_orderkey"), F.col("l_orderkey") + F.col("l_linenumber")
    return {
        "customers": Level(CUSTOMERS, c, (), "c_acctbal", "c_mktsegment"),
        "orders": Level(ORDERS, o, (F.col("o_custkey"),), "o_totalprice", "o_orderpriority"),
        "lines": Level(
            LINES, l, (F.col("l_custkey"), F.col("l_orderkey")), "l_quantity", "l_returnflag"
        ),
    }


def source_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name != "lines":
        return table(spark, sf_dir, {"customers": "customer"}.get(name, name))
    lines = last_wins(table(spark, sf_dir, "lineitem", costly=True), LINE_KEY, LINE_ORDER)
    owner = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_custkey")
    )
    return lines.join(owner, "l_orderkey")


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _levels()[name].stored(source_rows(spark, sf_dir, name))


def incoming(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _levels()[name].incoming(source_rows(spark, sf_dir, name))


def both(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Old and new tables; what both lines are cut from is made once."""
    levels, rows = _levels(), {name: source_rows(spark, sf_dir, name) for name in SPECS}
    rows["lines"] = settle(rows["lines"].select("l_custkey", *LINE_KEY, "l_partkey", "l_quantity", "l_returnflag"), "lines")
    return {n: levels[n].stored(r) for n, r in rows.items()}, {n: levels[n].incoming(r) for n, r in rows.items()}


# The same snapshots, for the SQL side.
STORED_AT = "'2000-01-01T00:00:00.000Z'"
RUN_AT = "'2025-01-02T03:04:05.678Z'"

LINE_U_SQL = """
line_u AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
               l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC, l_shipdate DESC) AS rn
    FROM lineitem) WHERE rn = 1)"""


def _cut_sql(name: str, source: str, keys: list[str], cols: list[str], num: str, txt: str) -> str:
    key = keys[-1]
    alive = {m: " AND ".join(f"({k}) % {m} <> 0" for k in keys) for m in (10, 11)}
    plain = ", ".join(c for c in cols if c not in (num, txt))
    return f"""
old_{name} AS (
  SELECT {plain}, {num}, CASE WHEN ({key}) % 26 <> 0 THEN {txt} END AS {txt}
  FROM {source} WHERE {alive[10]}),
new_{name} AS (
  SELECT {plain}, CASE WHEN ({key}) % 7 = 0 THEN {num} + 1 ELSE {num} END AS {num},
         CASE WHEN ({key}) % 13 <> 0 THEN {txt} END AS {txt}
  FROM {source} WHERE {alive[11]})"""


_CUTS_SQL = {
    "customers": _cut_sql(
        "customers",
        "customer",
        ["c_custkey"],
        ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"],
        "c_acctbal",
        "c_mktsegment",
    ),
    "orders": _cut_sql(
        "orders",
        "orders",
        ["o_custkey", "o_orderkey"],
        ["o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
        "o_totalprice",
        "o_orderpriority",
    ),
    "lines": LINE_U_SQL
    + """,
line_k AS (SELECT line_u.*, o_custkey AS l_custkey FROM line_u JOIN orders ON o_orderkey = l_orderkey)"""
    + ","
    + _cut_sql(
        "lines",
        "line_k",
        ["l_custkey", "l_orderkey", "l_orderkey + l_linenumber"],
        ["l_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"],
        "l_quantity",
        "l_returnflag",
    ),
}


def feed_sql(name: str) -> str:
    """A CTE feed_<name>: key columns and op, by full join."""
    spec = SPECS[name]
    differs = " OR ".join(f"o.{c} IS DISTINCT FROM n.{c}" for c in spec.data_cols)
    match = " AND ".join(f"o.{c} = n.{c}" for c in spec.pk)
    keys = ", ".join(f"coalesce(o.{c}, n.{c}) AS {c}" for c in spec.pk)
    last = spec.id_name
    return f"""
feed_{name} AS (
  SELECT {keys},
         CASE WHEN o.{last} IS NULL THEN 'insert' WHEN n.{last} IS NULL THEN 'delete'
              WHEN {differs} THEN 'update' ELSE 'unchanged' END AS op
  FROM old_{name} o FULL JOIN new_{name} n ON {match})"""


def with_sql(*names: str, feeds: bool = False) -> str:
    parts = [_CUTS_SQL[n] for n in names]
    if feeds:
        parts += [feed_sql(n) for n in names]
    return "WITH" + ",".join(parts)
