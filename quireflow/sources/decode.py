"""YAML and TOML text to records, decoded in Arrow batches on the executors."""

from __future__ import annotations

import datetime
import json
import math
import re
import tomllib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions.typed import parse_record
from quireflow.sources.corpus import frontmatter

# Plain scalars of the YAML 1.2 core schema; anything else is a string.
_NULL = r"^(?:~|null|Null|NULL|)$"
_BOOL = r"^(?:true|True|TRUE|false|False|FALSE)$"
_INT = r"^(?:[-+]?(?:0|[1-9][0-9]*)|0x[0-9a-fA-F]+|0o[0-7]+)$"
_FLOAT = (
    r"^(?:[-+]?(?:\.[0-9]+|(?:0|[1-9][0-9]*)\.[0-9]*)(?:[eE][-+]?[0-9]+)?"
    r"|[-+]?(?:0|[1-9][0-9]*)[eE][-+]?[0-9]+|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$"
)


@lru_cache(maxsize=1)
def _yaml_loader():
    """PyYAML's safe loader with the core schema: dates, yes/no and 1:30 stay strings."""
    import yaml

    base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    class CoreLoader(base):
        yaml_implicit_resolvers: dict = {}

    def integer(loader, node) -> int:
        text = loader.construct_scalar(node)
        return int(text, 0) if text[:2] in ("0x", "0o") else int(text)

    def real(loader, node) -> float:
        return float(loader.construct_scalar(node).lower().replace(".inf", "inf").replace(".nan", "nan"))

    def boolean(loader, node) -> bool:
        return loader.construct_scalar(node).lower() == "true"

    for tag, pattern, first in (
        ("null", _NULL, ["~", "n", "N", ""]),
        ("bool", _BOOL, list("tTfF")),
        ("int", _INT, list("-+0123456789")),
        ("float", _FLOAT, list("-+.0123456789")),
    ):
        CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), first)
    CoreLoader.add_constructor("tag:yaml.org,2002:int", integer)
    CoreLoader.add_constructor("tag:yaml.org,2002:float", real)
    CoreLoader.add_constructor("tag:yaml.org,2002:bool", boolean)
    return lambda text: yaml.load(text, Loader=CoreLoader)


def _plain(value: Any) -> Any:
    """Values JSON has no form for: dates and times as ISO text, infinities as null."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, (datetime.date, datetime.time)):
        return value.isoformat()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def _decode(text: str | None, syntax: str | None, without: str | None) -> tuple:
    record: Any = {}
    if syntax is not None and text is not None:
        try:
            record = _yaml_loader()(text) if syntax == "yaml" else tomllib.loads(text)
        except Exception as error:
            # Whatever the decoder rejects is a bad document, not a bad job.
            return None, f"Parse{syntax.capitalize()}: {(str(error).splitlines() or [type(error).__name__])[0]}"
    if not isinstance(record, dict):
        return None, f"Parse{str(syntax).capitalize()}: not a mapping"
    record.pop(without, None)
    return json.dumps(_plain(record), ensure_ascii=False), None


#: Bytes of texts that a worker turns into Python values at a time.
SLICE_BYTES = 1 << 20


def _slices(texts: pa.Array, syntaxes: pa.Array) -> Iterator[tuple[list, list]]:
    """A batch's texts and syntaxes, a few at a time: about ``SLICE_BYTES`` or one text."""
    step = max(1, len(texts) * SLICE_BYTES // max(texts.nbytes, 1))
    for at in range(0, len(texts), step):
        yield texts.slice(at, step).to_pylist(), syntaxes.slice(at, step).to_pylist()


def _decoder(without: str | None) -> Callable[[Iterator[tuple[pa.Array, pa.Array]]], Iterator[pa.Array]]:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, syntaxes in batches:
            for some in _slices(texts, syntaxes):
                done = [_decode(t, s, without) for t, s in zip(*some, strict=True)]
                yield pa.StructArray.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["raw", "decode_error"])

    return run


def decode(
    docs: DataFrame,
    keep: list[str],
    text: Column,
    syntax: Column,
    body: Column | None = None,
    body_column: str | None = None,
) -> DataFrame:
    """(keep…, raw, decode_error, record): each text decoded to JSON and parsed to VARIANT.

    ``syntax`` is yaml, toml or null (no frontmatter: an empty record). A Markdown body goes into
    the record under ``body_column``, in place of a field of that name. Only the text to decode goes through Python, in small
    slices of a batch, since a worker keeps what it once took; bodies and what is kept stay in the JVM.
    """
    decoder = F.arrow_udf(_decoder(body_column), "raw string, decode_error string")
    rows = docs.select(
        *keep,
        (F.lit(None).cast("string") if body is None else body).alias("__body"),
        decoder(text, syntax).alias("__decoded"),
    ).select(*keep, "__body", "__decoded.*")
    if body_column is not None:
        own = F.to_json(F.struct(F.col("__body").alias(body_column)), {"ignoreNullFields": "false"})
        # {"a": 1} and {"body": "text"} become {"a": 1, "body": "text"}.
        with_body = F.concat(F.substring("raw", F.lit(1), F.length("raw") - 1), F.lit(", "), F.substring(own, F.lit(2), F.length(own)))
        rows = rows.withColumn("raw", F.when(F.col("raw") == "{}", own).otherwise(with_body))
    return rows.drop("__body").withColumn("record", parse_record(F.col("raw")))


def markdown_records(docs: DataFrame, keep: list[str], text: str, body_column: str) -> DataFrame:
    """Markdown documents to records: frontmatter split, decoded, body put in."""
    parts = docs.select(*keep, frontmatter(F.col(text)).alias("f"))
    out = decode(
        parts.select(*keep, "f.*"), [*keep, "error"], F.col("front"), F.col("syntax"), F.col("body"), body_column
    )
    return out.withColumn("decode_error", F.coalesce("error", "decode_error")).drop("error")
