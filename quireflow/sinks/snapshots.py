"""Stored tables in key-hash buckets, under one log of commits.

A commit is one file that names the state of every table, so readers see all tables of a run or none of it, and a
run that dies between two tables leaves no trace but files that ``vacuum`` removes. Writers are optimistic: a
run stages its tables while others go on, claims the next number in the log, and fails with ``Conflict`` only if a commit since its start
has changed one of its own tables.

A table is cut into buckets by a hash of its key. A state says which folder holds each bucket now, so a run writes the buckets
it touches and points to the old folders for the rest. Streams append deltas, which hold new versions of rows; readers take
the last version of a key, and after ``MAX_DELTAS`` of them the buckets they touch are rewritten.

Each bucket has a digest of its keys and data, without timestamps, and a state the digest of those: what need not be
compared with an incoming table is known before anything stored is read.

The folder must be visible to all executors. A commit is claimed by creating its file, which must fail if the file is
there (true of HDFS and POSIX; an object store needs a connector that creates conditionally). A file that is not whole does not count.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.operators.dedup import last_wins

BUCKET, SEQ = "__bucket", "__seq"
#: Deltas of a table before the buckets they touch are rewritten.
MAX_DELTAS = 8


class Conflict(RuntimeError):
    """Another run has changed the same table meanwhile."""


def columns_of(schema: T.StructType) -> list[tuple[str, str]]:
    """Names and types; whether a column may be null does not count."""
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    """A row's bucket, by a hash of its key; tables without a key have one."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int") if key else F.lit(0)


def row_digest(columns: Sequence[str]) -> Column:
    # A null is skipped by the hash, so its place is hashed as well.
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def bucket_digests(rows: DataFrame, columns: Sequence[str]) -> dict[int, str]:
    """Digest of each bucket of ``rows``, which hold BUCKET; the order of rows does not count."""
    h = F.col("h")
    sums = (
        rows.select(BUCKET, row_digest(columns).alias("h"))
        .groupBy(BUCKET)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(h).alias("x"),
            F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
            F.sum(F.shiftrightunsigned(h, 32)).alias("high"),
        )
    )
    # As many rows as buckets, whatever the size of the table.
    return {r[BUCKET]: f"{r.n}:{r.x & (2**64 - 1):016x}:{r.low:x}:{r.high:x}" for r in sums.collect()}


@dataclass(frozen=True)
class TableState:
    """Where a table's buckets are. ``live`` and ``deltas`` map folders to the buckets that count there.

    Buckets go by a hash of ``by``, the key or a part of it that rows which change together share.
    """

    key: tuple[str, ...]
    by: tuple[str, ...]
    buckets: int
    schema: str
    digested: tuple[str, ...]
    live: Mapping[str, Sequence[int]] = field(default_factory=dict)
    deltas: Mapping[str, Sequence[int]] = field(default_factory=dict)
    digests: Mapping[int, str] = field(default_factory=dict)

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    def columns(self) -> list[tuple[str, str]]:
        return columns_of(self.struct())

    @property
    def root(self) -> str:
        """One digest for the whole table; empty while deltas are not counted in."""
        leaves = "\n".join(f"{b} {d}" for b, d in sorted(self.digests.items()))
        return "" if self.deltas else hashlib.sha256(leaves.encode()).hexdigest()

    def dirty(self, digests: Mapping[int, str]) -> list[int]:
        """Buckets that may differ from a table with these digests."""
        if self.deltas:
            return list(range(self.buckets))
        return sorted(b for b in {*digests, *self.digests} if digests.get(b) != self.digests.get(b))

    @staticmethod
    def load(value: dict) -> TableState:
        digests = {int(b): d for b, d in value["digests"].items()}
        return TableState(**value | {"key": tuple(value["key"]), "by": tuple(value["by"]), "digested": tuple(value["digested"]), "digests": digests})


@dataclass(frozen=True)
class View:
    """All tables as of one commit."""

    store: SnapshotStore
    version: int
    tables: Mapping[str, TableState]

    def read(self, table: str, buckets: Iterable[int] | None = None, with_bucket: bool = False) -> DataFrame | None:
        """A table, or some buckets of it; nothing if it was never written."""
        state = self.tables.get(table)
        if state is None:
            return None
        wanted = None if buckets is None else set(buckets)
        schema = state.struct()
        parts = [self._folder(schema, f, b, wanted, 0) for f, b in state.live.items()]
        parts += [self._folder(schema, f, b, wanted, k + 1) for k, (f, b) in enumerate(state.deltas.items())]
        parts = [p for p in parts if p is not None]
        spark = self.store.spark
        if not parts:
            rows = spark.createDataFrame([], schema.add(BUCKET, T.IntegerType()).add(SEQ, T.IntegerType()))
        else:
            rows = reduce(DataFrame.unionByName, parts)
        if state.deltas:
            rows = last_wins(rows, [*state.key, BUCKET], [SEQ])
        return rows.drop(SEQ) if with_bucket else rows.drop(SEQ, BUCKET)

    def _folder(self, schema: T.StructType, folder: str, live: Sequence[int], wanted: set[int] | None, seq: int) -> DataFrame | None:
        some = sorted(live if wanted is None else wanted & set(live))
        if not some:
            return None
        whole = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        rows = self.store.spark.read.schema(whole).parquet(f"{self.store.root}/{folder}")
        # Buckets are folders, so the others are pruned before anything is listed or read.
        return rows.where(F.col(BUCKET).isin(some)).withColumn(SEQ, F.lit(seq))


class Run:
    """Tables staged on top of a view; nothing of it is seen before ``commit``."""

    def __init__(self, view: View) -> None:
        self.view = view
        self.store = view.store
        self.staged: dict[str, TableState] = {}

    def state(self, table: str) -> TableState | None:
        return self.staged.get(table, self.view.tables.get(table))

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """A table as of this run, with what is staged so far."""
        return replace(self.view, tables={**self.view.tables, **self.staged}).read(table, buckets)

    def replace(
        self, table: str, rows: DataFrame, key: Sequence[str] = (), touched: Iterable[int] | None = None, ignore: Sequence[str] = (), by: Sequence[str] | None = None
    ) -> None:
        """Write ``rows`` as the table, or as its ``touched`` buckets, of which they are all rows then.

        Columns in ``ignore`` do not count in digests. ``by`` says what a new table's buckets go by, its key by default.
        """
        before = self.state(table)
        same = before is not None and tuple(key) == before.key
        by = before.by if same and by is None else tuple(key if by is None else by)
        if not set(by) <= set(key):
            raise ValueError("buckets go by columns of the key")
        n = before.buckets if same else self.store.buckets if key else 1
        digested = tuple(c for c in rows.columns if c not in ignore)
        if before is None or before.buckets != n or before.key != tuple(key) or before.by != by or before.columns() != columns_of(rows.schema):
            touched = None if before is None or touched is None else self._must_be_whole(table)
        folder, found = self._write(table, rows, by, n)
        digests = bucket_digests(found, digested)
        live = {folder: sorted(digests)} if digests else {}
        deltas: dict[str, Sequence[int]] = {}
        if touched is not None:
            gone = set(touched)
            if not set(digests) <= gone:
                raise ValueError(f"rows of {table} outside of the touched buckets")
            live |= {f: rest for f, b in before.live.items() if (rest := [x for x in b if x not in gone])}
            deltas = {f: rest for f, b in before.deltas.items() if (rest := [x for x in b if x not in gone])}
            digests |= {b: d for b, d in before.digests.items() if b not in gone}
        self.staged[table] = TableState(tuple(key), by, n, rows.schema.json(), digested, live, deltas, digests)

    @staticmethod
    def _must_be_whole(table: str) -> None:
        raise ValueError(f"the key, columns or number of buckets of {table} have changed: write it as a whole")

    def append(self, table: str, rows: DataFrame) -> None:
        """Add new versions of rows of a stored table with a key."""
        before = self.state(table)
        if before is None or not before.key:
            raise ValueError(f"{table} has no stored state with a key")
        schema = before.struct()
        folder, found = self._write(table, rows.select(*schema.names), before.by, before.buckets)
        some = sorted(r[0] for r in found.select(BUCKET).distinct().collect())
        if some:
            self.staged[table] = replace(before, deltas={**before.deltas, folder: some})

    def compact(self, table: str) -> None:
        """Rewrite the buckets that have deltas, once there are too many deltas."""
        state = self.state(table)
        if state is None or len(state.deltas) < MAX_DELTAS:
            return
        touched = sorted({b for some in state.deltas.values() for b in some})
        ignore = [c for c in state.struct().names if c not in state.digested]
        self.replace(table, self.read(table, touched), state.key, touched, ignore=ignore)

    def _write(self, table: str, rows: DataFrame, by: Sequence[str], buckets: int) -> tuple[str, DataFrame]:
        folder = f"{table}/data-{uuid.uuid4().hex}"
        cut = rows.withColumn(BUCKET, bucket_of(by, buckets))
        if by:
            cut = cut.repartition(BUCKET)
        cut.write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.store.root}/{folder}")
        whole = T.StructType([*rows.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return folder, self.store.spark.read.schema(whole).parquet(f"{self.store.root}/{folder}")

    def commit(self) -> int:
        """Make all staged tables current at once. A run without changes leaves the log as it is."""
        if not self.staged:
            return self.view.version
        names = {table: self.store._put_state(table, state) for table, state in self.staged.items()}
        version = self.view.version
        known, latest = self.store._log(version), version
        while True:
            version += 1
            held = self.store._claim(version, known | names)
            if held:
                return version
            # Someone else has this number; a broken file counts as none.
            other = self.store._log(version)
            if other is None:
                continue
            changed = {t for t in other if other[t] != self.store._log(latest).get(t)}
            if changed & set(names):
                raise Conflict(f"commit {version} has changed {sorted(changed & set(names))}")
            known, latest = other, version


class SnapshotStore:
    """Stored tables below one folder. ``buckets`` is the number that new tables with a key are cut into."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---------------------------------------------------------- files

    def _get(self, name: str) -> dict | None:
        """A whole JSON file, or nothing."""
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def _create(self, name: str, value: dict) -> bool:
        """Write a file that is not there yet; tells whether it was this call that did."""
        try:
            stream = self._fs.create(self._path(f"{self.root}/{name}"), False)
        except Py4JJavaError as error:
            if "Exist" in error.java_exception.getClass().getName() or "already exists" in str(error.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        return True

    def _put_state(self, table: str, state: TableState) -> str:
        name = f"{table}/state-{uuid.uuid4().hex}.json"
        self._create(name, asdict(state))
        return name

    def _numbers(self) -> list[int]:
        base = self._path(f"{self.root}/_log")
        if not self._fs.exists(base):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(base)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _log(self, version: int) -> dict[str, str] | None:
        """Names of the tables' states at a commit; nothing if its file is missing or not whole."""
        if version == 0:
            return {}
        found = self._get(f"_log/{version:012d}.json")
        return found["tables"] if found else None

    def _claim(self, version: int, tables: dict[str, str]) -> bool:
        return self._create(f"_log/{version:012d}.json", {"tables": tables, "at": time.time()})

    # ---------------------------------------------------------- reading

    def at(self, version: int | None = None) -> View:
        """All tables as of a commit, by default the last one."""
        for number in reversed(self._numbers()) if version is None else [version]:
            names = self._log(number)
            if names is not None:
                return View(self, number, {t: TableState.load(self._get(n)) for t, n in names.items()})
        if version is None:
            return View(self, 0, {})
        raise ValueError(f"there is no commit {version}")

    def versions(self, table: str) -> list[int]:
        """Commits that changed the table, oldest first."""
        out, before = [], None
        for number in self._numbers():
            now = (self._log(number) or {}).get(table, before)
            if now != before:
                out.append(number)
            before = now
        return out

    def read(self, table: str) -> DataFrame | None:
        """The current state of a table, or nothing if it was never written."""
        return self.at().read(table)

    # ---------------------------------------------------------- writing

    def begin(self) -> Run:
        return Run(self.at())

    def write(self, table: str, rows: DataFrame, key: Sequence[str] = ()) -> DataFrame:
        """Replace a table and return it as read back, with the lineage cut at the files."""
        return self.write_all({table: rows}, {table: key})[table]

    def write_all(
        self, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None, ignore: Sequence[str] = ()
    ) -> dict[str, DataFrame]:
        """Replace several tables in one commit."""
        run = self.begin()
        for name, rows in tables.items():
            run.replace(name, rows, (keys or {}).get(name, ()), ignore=ignore)
        view = self.at(run.commit())
        return {name: view.read(name) for name in tables}

    def vacuum(self, keep: int = 1, grace: float = 3600.0) -> list[str]:
        """Delete what none of the last ``keep`` commits names, and commits before those.

        Files younger than ``grace`` seconds stay, as a run may have staged and not committed them yet. Returns what is gone.
        """
        numbers = [n for n in self._numbers() if self._log(n) is not None]
        kept, old = numbers[-keep:], numbers[:-keep]
        used: set[str] = set()
        for number in kept:
            for name in self._log(number).values():
                state = TableState.load(self._get(name))
                used |= {name, *state.live, *state.deltas}
        limit = (time.time() - grace) * 1000
        gone = [f"_log/{n:012d}.json" for n in old]
        for table in self._fs.listStatus(self._path(self.root)) if self._fs.exists(self._path(self.root)) else []:
            name = table.getPath().getName()
            if name != "_log" and table.isDirectory():
                found = [(f"{name}/{s.getPath().getName()}", s.getModificationTime()) for s in self._fs.listStatus(table.getPath())]
                gone += [n for n, at in found if at <= limit and n not in used and n.split("/")[1].startswith(("data-", "state-"))]
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return gone
