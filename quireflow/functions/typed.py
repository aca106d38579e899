"""Typed validation of JSON records held as VARIANT.

A VARIANT keeps what a typed ``from_json`` loses: whether a field is missing or null,
and whether a number was written as integer or real. All checks, those of nested records
included, are expressions on the document's own row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow.specs import Field, TableSpec

ERROR_TYPE = "array<struct<id:string,field:string,code:string,expected:string,got:string>>"

# Error codes of a rejected record.
MISSING, MISMATCH, BAD_DATE, BAD_DATETIME, COMPUTED = (
    "MissingField",
    "TypeMismatch",
    "InvalidDate",
    "InvalidDatetime",
    "FoundComputedField",
)

DATE = r"^(\d{1,4}|[+-]\d{4,6})-\d{1,2}-\d{1,2}$"
DATETIME = r"^(\d{1,4}|[+-]\d{4,6})-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?$"

U64_MAX = "18446744073709551615"


def parse_record(raw: Column) -> Column:
    return F.try_parse_json(raw)


def child(record: Column, name: str) -> Column:
    """A field as VARIANT; null only if it is missing, not if it holds a null."""
    return F.try_variant_get(record, f'$["{name}"]', "variant")


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _is_real(bound: Column) -> Column:
    """Written as a real. Integers beyond 64 bits are read as reals, as JSON readers do."""
    kind = bound["kind"]
    digits = F.regexp_extract(kind, r"^DECIMAL\((\d+),", 1).try_cast("int")
    scale = F.regexp_extract(kind, r",(\d+)\)$", 1)
    above = F.try_variant_get(bound["v"], "$", "decimal(38,0)") > F.lit(U64_MAX).cast("decimal(38,0)")
    decimal = (scale != "0") | (digits < 19) | F.coalesce(above, F.lit(False))
    return (kind == "DOUBLE") | (kind.startswith("DECIMAL") & decimal)


def _padded_date(text: Column) -> Column:
    """Year, month and day padded as Spark's date cast needs them."""
    sign = F.regexp_extract(text, r"^([+-]?)", 1)
    parts = [F.regexp_extract(text, r"^[+-]?(\d+)-(\d+)-(\d+)", i) for i in (1, 2, 3)]
    year = F.when(F.length(parts[0]) < 4, F.lpad(parts[0], 4, "0")).otherwise(parts[0])
    return F.concat(
        sign, year, F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0")
    )


def to_date(text: Column) -> Column:
    """ISO date or null; no time part, no surplus text."""
    usual = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), text.try_cast("date"))
    return usual.when(text.rlike(DATE), _padded_date(text).try_cast("date"))


def to_datetime(text: Column) -> Column:
    """Zone-less ISO date and time joined by ``T``, or null."""
    clock = [F.lpad(F.regexp_extract(text, r"T(\d+):(\d+):(\d+)", i), 2, "0") for i in (1, 2, 3)]
    fraction = F.regexp_extract(text, r"(\.\d+)$", 1)
    iso = F.concat(_padded_date(text), F.lit("T"), F.concat_ws(":", *clock), fraction)
    plain = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?$")
    usual = F.when(plain, text.try_cast("timestamp_ntz"))
    return usual.when(text.rlike(DATETIME), iso.try_cast("timestamp_ntz"))


# Per kind: the expected type's name, and whether a present value has it.
_TYPE_TESTS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "id": ("string", lambda b: b["kind"] == "STRING"),
    "string": ("string", lambda b: b["kind"] == "STRING"),
    "image": ("string", lambda b: b["kind"] == "STRING"),
    "file": ("string", lambda b: b["kind"] == "STRING"),
    "markdown": ("string", lambda b: b["kind"] == "STRING"),
    "integer": ("integer", lambda b: b["kind"] == "BIGINT"),
    "real": ("real", _is_real),
    "boolean": ("boolean", lambda b: b["kind"] == "BOOLEAN"),
    "date": ("date", lambda b: b["kind"] == "STRING"),
    "datetime": ("datetime", lambda b: b["kind"] == "STRING"),
    "records": ("array", lambda b: b["items"].isNotNull()),
}


def bind(record: Column, spec: TableSpec, specs: dict[str, TableSpec]) -> Column:
    """Every declared field of a record, taken out of it once, records below included.

    A struct per field: the value ``v``, its ``kind`` and its ``text``; for a records field
    the ``items`` instead. Put it in a column of its own: checks and typed values then
    only read struct fields, and no VARIANT is searched twice.
    """
    return F.struct(
        *[bind_field(record, name, f, specs).alias(name) for name, f in spec.fields if not f.is_timestamp]
    )


def bind_field(record: Column, name: str, field: Field, specs: dict[str, TableSpec]) -> Column:
    value = child(record, name)
    if field.kind != "records":
        return F.struct(value.alias("v"), kind_of(value).alias("kind"), as_text(value).alias("text"))
    below = specs[field.table or name]

    def item(e: Column) -> Column:
        bare = F.when(kind_of(e) == "STRING", as_text(e)) if below.id_only else F.lit(None).cast("string")
        return F.struct(
            e.alias("v"),
            bare.alias("bare"),
            F.when(is_object(e), bind(e, below, specs)).alias("inner"),
        )

    array = F.try_variant_get(value, "$", "array<variant>")
    return F.struct(value.alias("v"), F.transform(array, item).alias("items"))


def _error(cid: Column, name: str, code: str, expected: str | None, got: Column | None) -> Column:
    return F.struct(
        cid.alias("id"),
        F.lit(name).alias("field"),
        F.lit(code).alias("code"),
        F.lit(expected).cast("string").alias("expected"),
        (F.lit(None) if got is None else got).cast("string").alias("got"),
    )


def field_error(bound: Column, name: str, field: Field, cid: Column) -> Column:
    """The error of one bound field, or null."""
    present = bound["v"].isNotNull()
    if field.kind == "hash":
        return F.when(present, _error(cid, name, COMPUTED, None, None))
    expected, fits = _TYPE_TESTS[field.kind]
    wrong = present & ~F.coalesce(fits(bound), F.lit(False))
    found = F.when(wrong, _error(cid, name, MISMATCH, expected, F.to_json(bound["v"])))
    if field.required or field.kind == "id":
        found = found.when(~present, _error(cid, name, MISSING, None, None))
    if field.kind in ("date", "datetime"):
        parse, code = (to_date, BAD_DATE) if field.kind == "date" else (to_datetime, BAD_DATETIME)
        text = bound["text"]
        found = found.when(present & parse(text).isNull(), _error(cid, name, code, None, text))
    return found


def field_value(bound: Column, field: Field) -> Column:
    """The typed value of one bound field; null if it is missing or of another type."""
    if field.kind == "integer":
        return F.when(bound["kind"] == "BIGINT", F.try_variant_get(bound["v"], "$", "bigint"))
    if field.kind == "real":
        return F.when(_is_real(bound), F.try_variant_get(bound["v"], "$", "double"))
    if field.kind == "boolean":
        return F.when(bound["kind"] == "BOOLEAN", F.try_variant_get(bound["v"], "$", "boolean"))
    text = F.when(bound["kind"] == "STRING", bound["text"])
    return {"date": to_date, "datetime": to_datetime}.get(field.kind, lambda t: t)(text)


def record_errors(
    bound: Column, spec: TableSpec, specs: dict[str, TableSpec], prefix: Column | None = None
) -> Column:
    """All errors of a bound record and of the records below it, as one array.

    ``id`` is the compound id, with ``?`` for an id that cannot be read.
    """
    own = F.coalesce(field_value(bound[spec.id_name], Field("id")), F.lit("?"))
    cid = own if prefix is None else F.concat(prefix, F.lit("/"), own)
    fields = [(name, f) for name, f in spec.fields if not f.is_timestamp]
    parts = [F.array_compact(F.array(*[field_error(bound[n], n, f, cid) for n, f in fields]))]
    parts += [
        _element_errors(bound[n]["items"], n, specs[f.table or n], specs, cid)
        for n, f in fields
        if f.kind == "records"
    ]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _element_errors(
    items: Column, name: str, below: TableSpec, specs: dict[str, TableSpec], cid: Column
) -> Column:
    none = F.array().cast(ERROR_TYPE)

    def of_element(e: Column) -> Column:
        wrong = F.array(_error(cid, name, MISMATCH, "object", F.to_json(e["v"])))
        nested = record_errors(e["inner"], below, specs, cid)
        return F.when(e["bare"].isNotNull(), none).when(e["inner"].isNotNull(), nested).otherwise(wrong)

    return F.coalesce(F.flatten(F.transform(items, of_element)), none)


def typed_record(bound: Column, spec: TableSpec, specs: dict[str, TableSpec]) -> list[Column]:
    """The declared columns of a bound record; timestamp and hash fields are left out."""
    out = []
    for name, f in spec.fields:
        if f.is_timestamp or f.kind == "hash":
            continue
        if f.kind == "records":
            out.append(_typed_elements(bound[name]["items"], specs[f.table or name], specs).alias(name))
        else:
            out.append(field_value(bound[name], f).alias(name))
    return out


def _typed_elements(items: Column, below: TableSpec, specs: dict[str, TableSpec]) -> Column:
    def of_element(e: Column) -> Column:
        if below.id_only:
            return F.coalesce(e["bare"], field_value(e["inner"][below.id_name], Field("id")))
        return F.struct(*typed_record(e["inner"], below, specs))

    return F.transform(items, of_element)
