"""Vector code compression by Lloyd's rounds over resident members.

A vector is cut into ``parts`` equal parts, and each part position has a codebook. Every part lives in the partition
that owns its (position, entry, salt). Owners add up their resident members; the sums of all owners, one row for each entry, give the next codebooks.
Owners then look up their members' nearest entries again, and only parts whose entry changed travel in the next
shuffle; the others stay where they are. An entry that holds many parts has as many salts as it takes for
an owner to be small, so that a hot entry is spread over partitions, however alike its members are.

Members are parts without their row's id. The codes of the rows come from one last pass over the table with the final
codebooks, which no row has to be put together for.

Each round's assignment is checkpointed to the shared folder and the round before it deleted, so a lost executor
costs at most one round.

Defined cases: a vector that is null or holds a null or non-finite component takes no part; shorter vectors count as padded with zeros up
to the longest, and that to a multiple of ``parts``, which changes no distance; rows with the same id are rows of their own, a null id comes last, and
ties among the first ``entries`` ids go by the vector; fewer rows than ``entries`` give fewer entries; a
component beyond the bound of ``vectors.largest_step`` (2**27 at 64 components) is set to that bound, so that errors fit a long;
a label's sum of errors beyond a long is the largest long; other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.llm.common import remove_folder, settle
from quireflow.llm.vectors import finite, integers, largest_step, narrow, products
from quireflow.session import work_dir

#: Bytes of parts in a partition of owners, about.
PARTITION_BYTES = 32 << 20
#: Parts looked up at once.
CHUNK = 16384


@dataclass(frozen=True)
class Cut:
    """How vectors become integer parts."""

    parts: int
    step: int
    scale: int
    bound: int

    def of(self, vectors: pa.Array) -> np.ndarray:
        """Integer parts as (row, position, component)."""
        whole = integers(vectors, self.parts * self.step, self.scale, self.bound)
        return whole.reshape(len(whole), self.parts, self.step)


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (squared distance, ties to the lower index) and that distance."""
    index, error = np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=np.int64)
    norms = (book * book).sum(1)
    for at in range(0, len(values), CHUNK):
        x = values[at : at + CHUNK].astype(np.int64)
        ahead = norms[None, :] - 2 * products(x, book)
        index[at : at + CHUNK] = best = ahead.argmin(1)
        error[at : at + CHUNK] = ahead[np.arange(len(x)), best] + (x * x).sum(1)
    return index, error


@dataclass(frozen=True)
class Owners:
    """Who holds what: the number of salts of each (position, entry), dealt over ``width`` partitions."""

    salts: np.ndarray
    width: int

    def of(self, position: int, entries: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        salt = tokens.astype(np.uint64) % self.salts[position][entries].astype(np.uint64)
        key = np.uint64(position * self.salts.shape[1]) + entries.astype(np.uint64)
        # Salts of one entry lie on consecutive partitions, so that they share its load evenly.
        home = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return ((home + salt) % np.uint64(self.width)).astype(np.int64)

    def grown(self, counts: np.ndarray) -> Owners:
        """More salts for entries that have come to hold more parts; never fewer, so that few parts move for it."""
        room = max(1024, int(counts.sum()) // (4 * self.width))
        return Owners(np.maximum(self.salts, 1 + counts // room), self.width)


Block = tuple[int, np.ndarray, np.ndarray, np.ndarray]  # position, entries, tokens, values


def dealt(position: int, entries: np.ndarray, tokens: np.ndarray, values: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, Block]]:
    """One block for each owner."""
    order = np.argsort(owner, kind="stable")
    ends = np.flatnonzero(np.diff(owner[order])) + 1
    for rows in np.split(order, ends) if len(order) else []:
        yield int(owner[rows[0]]), (position, entries[rows], tokens[rows], values[rows])


def by_position(blocks: Iterator[tuple[int, Block]]) -> Iterator[Block]:
    """The members of a partition, one block for each position."""
    held: dict[int, list[Block]] = {}
    for _, block in blocks:
        held.setdefault(block[0], []).append(block)
    for position in sorted(held):
        kind = max((b[3].dtype for b in held[position]), key=lambda d: d.itemsize)
        columns = zip(*[(b[1], b[2], b[3].astype(kind, copy=False)) for b in held.pop(position)], strict=True)
        yield (position, *map(np.concatenate, columns))


def own(partition: int) -> int:
    """Records are keyed by the partition that owns them."""
    return partition


def first_owners(kept: DataFrame, books: np.ndarray, cut: Cut, owners: Owners) -> RDD:
    """Every part of the table, dealt to its first owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        # A token tells rows of a task apart; it depends on the row's place in the stored files only.
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = cut.of(batch.column(0))
            places = np.arange(seen, seen + len(values), dtype=np.uint64) + np.uint64(task) * np.uint64(0x9E3779B1)
            tokens = ((places * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)
            seen += len(values)
            for position in range(cut.parts):
                x = narrow(values[:, position])
                entries = nearest(x, books[position])[0].astype(np.int32)
                found = list(dealt(position, entries, tokens, x, owners.of(position, entries, tokens)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.int32()), pa.array([pickle.dumps(b, 5) for _, b in found], pa.binary())],
                    names=["owner", "block"],
                )

    def opened(rows: Iterator) -> Iterator[tuple[int, Block]]:
        import pickle

        return ((r[0], pickle.loads(bytes(r[1]))) for r in rows)

    return kept.mapInArrow(run, "owner int, block binary").rdd.mapPartitions(opened).partitionBy(owners.width, own)


def member_counts(kept: DataFrame, books: np.ndarray, cut: Cut) -> np.ndarray:
    """Parts nearest to each entry as (position, entry), for the first number of salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            values = cut.of(batch.column(0))
            for position in range(cut.parts):
                counts[position] += np.bincount(nearest(values[:, position], books[position])[0], minlength=books.shape[1])
        at = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts.ravel()[at], pa.int64())], names=["entry", "n"])

    out = np.zeros(books.shape[:2], dtype=np.int64)
    for r in kept.mapInArrow(run, "entry int, n long").groupBy("entry").agg(F.sum("n").alias("n")).collect():
        out.ravel()[r.entry] = r.n
    return out


def owner_sums(blocks: Iterator[tuple[int, Block]]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((position, entry), [count, sums of the components]) of a partition's members."""
    for position, entries, _, values in by_position(blocks):
        order = np.argsort(entries, kind="stable")
        ranked = entries[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        sums = np.add.reduceat(values[order].astype(np.int64), starts, axis=0)
        counts = np.diff(np.r_[starts, len(ranked)])
        for k, start in enumerate(starts):
            yield (position, int(ranked[start])), np.r_[counts[k], sums[k]]


def reassigned(books: np.ndarray, owners: Owners):
    """Members looked up again, keyed by their owners from now on."""

    def run(blocks: Iterator[tuple[int, Block]]) -> Iterator[tuple[int, Block]]:
        for position, _, tokens, values in by_position(blocks):
            entries = nearest(values, books[position])[0].astype(np.int32)
            yield from dealt(position, entries, tokens, values, owners.of(position, entries, tokens))

    return run


def staying(index: int, blocks: Iterator[tuple[int, Block]]) -> Iterator[tuple[int, Block]]:
    return (b for b in blocks if b[0] == index)


def moving(index: int, blocks: Iterator[tuple[int, Block]]) -> Iterator[tuple[int, Block]]:
    return (b for b in blocks if b[0] != index)


def settled_members(assigned: RDD) -> RDD:
    """Members at their owners: those that stay are not shuffled, those that move are."""
    moved = assigned.mapPartitionsWithIndex(moving).partitionBy(assigned.getNumPartitions(), own)
    return assigned.mapPartitionsWithIndex(staying, preservesPartitioning=True).union(moved)


def codebooks(kept: DataFrame, books: np.ndarray, cut: Cut, rounds: int, n: int) -> np.ndarray:
    """The codebooks after ``rounds`` updates, as (position, entry, component)."""
    spark = kept.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(spark, "lloyd"))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * cut.parts * cut.step * 2 // PARTITION_BYTES))
    counts = member_counts(kept, books, cut)
    owners = Owners(np.ones(books.shape[:2], dtype=np.int64), width).grown(counts)
    members = first_owners(kept, books, cut, owners)
    held = None
    for done in range(rounds):
        if done:
            owners = owners.grown(counts)
            before, held = held, members.mapPartitions(reassigned(books, owners), preservesPartitioning=True)
            held = _kept_safe(held)
            members = settled_members(held)
        else:
            before, held = None, _kept_safe(members)
            members = held
        books, counts = books.copy(), np.zeros_like(counts)
        for (position, entry), total in members.mapPartitions(owner_sums).reduceByKey(np.add).collect():
            counts[position, entry] = total[0]
            books[position, entry] = total[1:] // total[0]
        if before is not None:
            _forget(spark, before)
    if held is not None:
        _forget(spark, held)
    return books


def _kept_safe(members: RDD) -> RDD:
    members.persist(StorageLevel.MEMORY_AND_DISK)
    members.checkpoint()
    return members


def _forget(spark: SparkSession, members: RDD) -> None:
    members.unpersist()
    file = members.getCheckpointFile()
    if file:
        remove_folder(spark, file)


@dataclass(frozen=True)
class Compressed:
    """``rows`` (key, label, code, error), settled, and the final ``books`` as (position, entry, component)."""

    rows: DataFrame
    books: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def compress(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> Compressed:
    """Codes of all rows and the codebooks they refer to; a code has two hex digits for each part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part, so a codebook has 1 to 256 entries")
    kept = rows.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(finite("vector"))
    n, longest = kept.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    step = -(-longest // parts)
    cut = Cut(parts, step, scale, largest_step(parts * step, 4))
    # The first entries are ``entries`` rows at most, whatever the size of the table.
    first = kept.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    kind = pa.list_(pa.float64())
    books = cut.of(pa.array([list(r.vector) for r in first], kind)).transpose(1, 0, 2).copy()
    if n:
        books = codebooks(kept.select("vector"), books, cut, rounds, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = cut.of(batch.column(2))
            found = [nearest(values[:, p], books[p]) for p in range(parts)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())],
                names=["key", "label", "code", "error"],
            )

    schema = T.StructType([kept.schema["key"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return Compressed(settle(kept.mapInArrow(run, schema), "vector-codes"), books)


def report(found: Compressed) -> DataFrame:
    """vec_id, code, error, the error of all rows of the same label (nulls together) and the digest of the codebooks."""
    most = F.lit(2**63 - 1)
    sums = found.rows.groupBy(F.col("label").alias("of")).agg(F.coalesce(F.try_sum("error"), most).alias("label_error"))
    joined = found.rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same in SQL: one query, with an assignment and an update for each round."""
    ctes = [
        f"""kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n,
         list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS (
  SELECT n, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x
  FROM kept, range({parts}) t(p))""",
        f"book0 AS (SELECT p, n - 1 AS e, x AS c FROM parts WHERE n <= {entries})",
    ]
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for k in range(rounds + 1):
        # One number orders by distance, then by index.
        ctes.append(
            f"""near{k} AS (
  SELECT n, p, any_value(x) AS x, min({distance} * {entries} + e) AS best
  FROM parts JOIN book{k} USING (p) GROUP BY n, p)"""
        )
        if k < rounds:
            ctes.append(
                f"""mean{k} AS (
  SELECT p, e, list(s ORDER BY i) AS c FROM (
    SELECT p, best % {entries} AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS s
    FROM near{k}, range(1, (SELECT max(len(x)) FROM parts) + 1) t(i) GROUP BY ALL) GROUP BY p, e)"""
            )
            ctes.append(f"book{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))")
    ctes.append(
        f"""coded AS (
  SELECT n, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error
  FROM near{rounds} GROUP BY n)"""
    )
    ctes.append(
        f"digest AS (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda y: y::VARCHAR), 'string_agg', ','), ',' ORDER BY p, e)) AS d FROM book{rounds})"
    )
    return "WITH " + ",\n".join(ctes) + (
        "\nSELECT k.vec_id, code, error, sum(error) OVER (PARTITION BY k.label)::BIGINT AS label_error, d AS codebooks_sha256\n"
        "FROM kept k JOIN coded USING (n), digest"
    )
