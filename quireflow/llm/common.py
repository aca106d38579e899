"""What the operators share: words, folds, per-batch maps and settled tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.session import work_dir

#: White space of the word definition; also what ``bytes.split()`` splits at.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered; bytes methods touch ASCII only, as the definition asks."""
    return text.encode().lower().split() if text else []


def crc_fold(key: str, modulus: int) -> Column:
    """``crc32(key as text) mod modulus``; a null key has crc 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(0)) % modulus


def settle(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows once to the shared folder and read them back.

    Later plans start from files that every executor sees, so a lost executor costs a read.
    """
    folder = work_dir(rows.sparkSession, purpose)
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def quoted(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_names(rows: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``rows`` has."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in wanted:
        own = next(x for x in (f"__{name}{'_' * k}" for k in range(len(taken) + 1)) if x not in taken)
        taken.add(own)
        out.append(own)
    return out


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a settled folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(rows: DataFrame, column: str) -> int:
    """Total size of a text column, for choosing how many parts work is dealt into."""
    return rows.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def ddl(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(256, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_rows(rows: DataFrame, schema: str | T.StructType, fn: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """Run ``fn`` over each partition as an iterator of batches, each a dict of Python lists.

    ``fn`` yields dicts with one list or array for each column of ``schema``. Batches of large rows are handed on in slices of about
    ``SLICE_BYTES``, since a worker keeps what its largest batch took.
    """
    kinds = ddl(schema) if isinstance(schema, str) else schema
    fields = arrow_schema(kinds)

    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(dict(zip(names, part.to_pydict().values())) for batch in batches for part in slices(batch)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type, from_pandas=False) for f in fields], schema=fields)

    # Plain names on the way in: the call looks its columns up by name, and a name may hold any character.
    return rows.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, kinds)
