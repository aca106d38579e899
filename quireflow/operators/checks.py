"""Constraints Spark does not enforce, as queries that list or count violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.operators.joins import all_of
from quireflow.specs import TableSpec


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def orphan_keys(
    child: DataFrame, parent: DataFrame, child_key: Sequence[str], parent_key: Sequence[str]
) -> DataFrame:
    """Parent keys that child rows point to in vain, with the number of such rows.

    Child rows are counted per key before the join, so it sees each key once and a
    parent with very many children is no heavier than any other.
    """
    counts = child.groupBy(*child_key).agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_key, child_key, strict=True)])
    return counts.join(known, list(child_key), "left_anti")


def _object_ok(c: Column) -> Column:
    ref = F.from_json(
        c,
        "hash string, size bigint, content_type string, "
        "pointer struct<type:string,bucket:string,namespace:string,key:string,path:string,content:string>",
    )
    p = ref["pointer"]
    arms = (
        ((p["type"] == "r2") & p["bucket"].isNotNull() & p["key"].isNotNull())
        | ((p["type"] == "kv") & p["namespace"].isNotNull() & p["key"].isNotNull())
        | ((p["type"] == "asset") & p["path"].isNotNull())
        | ((p["type"] == "inline") & p["content"].isNotNull())
    )
    head = [ref["hash"].rlike("^[0-9a-f]{64}$"), ref["size"] >= 0, ref["content_type"].isNotNull()]
    return F.coalesce(all_of([*head, arms]), F.lit(False))


def _iso_date_ok(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull()


def _iso_datetime_ok(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}T") & c.try_cast("timestamp").isNotNull()


# A rule is broken by a row when its expression is false; null passes all but not_null.
RULES = {
    "not_null": lambda c: c.isNotNull(),
    "boolean": lambda c: c.isin(0, 1),
    "iso_date": _iso_date_ok,
    "iso_datetime": _iso_datetime_ok,
    "object_reference": _object_ok,
}

RULE_OF_KIND = {
    "boolean": "boolean",
    "date": "iso_date",
    "datetime": "iso_datetime",
    "created_at": "iso_datetime",
    "updated_at": "iso_datetime",
    "image": "object_reference",
    "file": "object_reference",
    "markdown": "object_reference",
}


def rules_for(spec: TableSpec) -> list[tuple[str, str]]:
    """The rules a table's stored rows must keep, from its declaration."""
    rules = [(c, "not_null") for c in spec.inherit_ids]
    for name, f in spec.fields:
        if f.kind == "records":
            continue
        if not f.nullable:
            rules.append((name, "not_null"))
        if f.kind in RULE_OF_KIND:
            rules.append((name, RULE_OF_KIND[f.kind]))
    return rules


def contract(df: DataFrame, rules: Mapping[str, str] | Sequence[tuple[str, str]]) -> DataFrame:
    """(column_name, rule, violations): one pass over the rows, however many rules."""
    pairs = list(rules.items()) if isinstance(rules, Mapping) else list(rules)
    counts = [
        F.count_if(~F.coalesce(RULES[rule](F.col(f"`{name}`")), F.lit(rule != "not_null"))).alias(f"n{i}")
        for i, (name, rule) in enumerate(pairs)
    ]
    report = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(rule).alias("rule"),
                F.col(f"n{i}").alias("violations"),
            )
            for i, (name, rule) in enumerate(pairs)
        ]
    )
    return df.agg(*counts).select(F.inline(report))
