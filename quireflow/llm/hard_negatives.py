"""Hard-negative mining by a secondary sort.

Pairs of anchors and rows become keys (anchor, descending score, id), packed into bytes whose order is the order of
the keys. ``repartitionAndSortWithinPartitions`` brings an anchor's pairs to one partition in that order, and an iterator reads them once: a
positive opens a window that reaches from its score down to a share of it, and each negative goes to the open windows
that still want one. It holds the windows of one anchor and a few negatives of one score, never an anchor's pairs.

What is sorted is bounded before the shuffle. Anchors and rows meet in the cells of a grid: a cell holds at most
``CELL_ROWS`` rows and ``CELL_ANCHORS`` anchors, whatever their labels, so neither a hot label nor a hot anchor makes a task larger
than others. A first pass over the grid gives each anchor's best rows of its own label; with their scores known, the second
lets through, for each cell, anchor and positive, only the first negatives of the positive's window. Nothing that the result could need is lost:
a row that is not among the first of its cell is not among the first of all.

Defined cases: rows without a label, without a vector or with a null or non-finite component take no part; a shorter
vector counts as padded with zeros; rows with the same id are rows of their own, each one an anchor if its id is one, and other than itself only;
equal scores go by the smaller id, a null id after all others and never an anchor; a component beyond the bound of
``vectors.largest_step`` (2**24 at 64 components) is set to that bound; other columns are not looked at. A positive with a negative score has an empty window.
An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import ddl, settle
from quireflow.llm.vectors import finite, largest_step, products

CELL_ROWS, CELL_ANCHORS = 1 << 17, 1 << 14
#: Scores worked on at once.
SCORES = 1 << 22
PAIR = "anchor long, anchor_id long, score long, id long, positive boolean"
KEY = struct.Struct(">QQBQ")
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def packed_key(anchor: int, score: int, row_id: int | None) -> bytes:
    """Bytes in the order of (anchor, descending score, id), a null id last."""
    return KEY.pack(anchor, 2**63 - 1 - score, row_id is None, 0 if row_id is None else row_id + 2**63)


def unpacked_key(key: bytes) -> tuple[int, int, int | None]:
    anchor, falling, missing, row_id = KEY.unpack(key)
    return anchor, 2**63 - 1 - falling, None if missing else row_id - 2**63


def mine(
    pairs: Iterator[tuple[bytes, tuple[int, bool]]], positives: int, negatives: int, low: int, high: int
) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows of the result from sorted (key, (anchor id, is positive)) pairs, read once."""
    at = level = None
    windows: list[list[int]] = []
    held: list[int] = []
    for key, (anchor_id, positive) in pairs:
        anchor, score, row_id = unpacked_key(key)
        if anchor != at:
            at, level, windows = anchor, None, []
        if score != level:
            level, held = score, []
        if positive:
            if len(windows) < positives:
                windows.append([row_id, score, 0])
                # Negatives with the same score and a smaller id came before the window was open.
                yield from _into(windows[-1:], anchor_id, held, score, negatives, low, high)
        else:
            if len(held) < negatives:
                held.append(row_id)
            yield from _into(windows, anchor_id, [row_id], score, negatives, low, high)


def _into(windows, anchor_id, ids, score, negatives, low, high):
    for window in windows:
        for row_id in ids:
            if window[2] < negatives and low * window[1] <= high * score:
                window[2] += 1
                yield anchor_id, window[0], window[2], row_id, window[1], score


def _first(scores: np.ndarray, among: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` of the places ``among`` by descending score, ties to the earlier place."""
    if len(among) > count:
        found = scores[among]
        among = among[found >= np.partition(found, len(found) - count)[len(found) - count]]
    return among[np.argsort(-scores[among], kind="stable")][:count]


class _Side:
    """One side of a cell, ordered by id with nulls last."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("id").combine_chunks()
        self.missing = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0), dtype=np.int64)
        order = np.lexsort((self.ids, self.missing))
        self.ids, self.missing = self.ids[order], self.missing[order]
        self.uid = np.asarray(table.column("uid"), dtype=np.int64)[order]
        self.label = np.asarray(table.column("label"), dtype=np.int64)[order]
        vector = table.column("vector").combine_chunks()
        flat, sizes = np.asarray(vector.flatten(), dtype=np.int64), np.asarray(vector.value_lengths(), dtype=np.int64)
        width = int(sizes.max()) if len(sizes) else 0
        self.vectors = np.zeros((len(sizes), width), dtype=np.int64)
        self.vectors[np.arange(width)[None, :] < sizes[:, None]] = flat
        self.vectors = self.vectors[order]
        self.windows = table.column("positives").take(pa.array(order)) if "positives" in table.column_names else None


def cell_pairs(rows: pa.Table, anchors: pa.Table, count: int, low: int, high: int) -> pa.Table:
    """Pairs of one cell: the best rows of the anchors' own labels, or, with known positives, the first negatives of each window."""
    r, a = _Side(rows), _Side(anchors)
    width = min(r.vectors.shape[1], a.vectors.shape[1])
    out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    step = max(1, SCORES // max(1, len(r.uid)))
    for start in range(0, len(a.uid), step):
        scores = products(a.vectors[start : start + step, :width], r.vectors[:, :width])
        for i, s in enumerate(scores, start):
            same = r.label == a.label[i]
            if a.windows is None:
                found = _first(s, np.flatnonzero(same & (r.uid != a.uid[i])), count)
            else:
                tops = sorted(set(a.windows[i].as_py()))
                picked = [_first(s, np.flatnonzero(~same & (s <= top) & (high * s >= low * top)), count) for top in tops]
                found = np.unique(np.concatenate(picked)) if picked else np.zeros(0, dtype=np.int64)
            out.append((i, len(found), s[found], found))
    repeat = np.repeat([i for i, *_ in out], [n for _, n, *_ in out]).astype(np.int64)
    found = np.concatenate([x[3] for x in out]).astype(np.int64) if out else np.zeros(0, dtype=np.int64)
    score = np.concatenate([x[2] for x in out]).astype(np.int64) if out else np.zeros(0, dtype=np.int64)
    columns = [
        pa.array(a.uid[repeat], pa.int64()),
        pa.array(a.ids[repeat], pa.int64()),
        pa.array(score, pa.int64()),
        pa.array(r.ids[found], pa.int64(), mask=r.missing[found]),
        pa.array(np.full(len(found), a.windows is None), pa.bool_()),
    ]
    return pa.Table.from_arrays(columns, names=[c.split()[0] for c in PAIR.split(", ")])


def _grid(rows: DataFrame, anchors: DataFrame, groups: int, blocks: int, count: int, low: int, high: int) -> DataFrame:
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int")).withColumn("b", every(blocks))
    right = anchors.withColumn("b", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")).withColumn("g", every(groups))
    meet = lambda r, a: cell_pairs(r, a, count, low, high)
    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(meet, ddl(PAIR))


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels
    whose score is between ``low / high`` of the positive's and the positive's own.

    The score is the inner product of ``floor(scale * x)``; ``is_anchor`` is an expression over ``rows``, null counts as false.
    """
    spark = rows.sparkSession
    kept = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    ).where(F.col("label").isNotNull() & finite("vector"))
    longest = kept.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    bound = float(largest_step(longest, 2 * max(low, high, 1)))
    whole = F.transform("vector", lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-bound)), F.lit(bound))).cast("int"))
    kept = settle(kept.withColumn("vector", whole).withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")
    members, anchors = kept.drop("anchor"), kept.where("anchor and id is not null").select(*[F.col(c).alias(c) for c in ("uid", "id", "label", "vector")])
    n, n_anchors = kept.agg(F.count(F.lit(1)), F.count_if(F.col("anchor"))).first()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, blocks = max(width, -(-n // CELL_ROWS)), max(1, -(-n_anchors // CELL_ANCHORS))
    best = _grid(members, anchors, groups, blocks, positives, low, high)
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    chosen = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place")
    chosen = settle(chosen, "negatives-positives")
    scores = chosen.groupBy(F.col("anchor").alias("uid")).agg(F.collect_list("score").alias("positives"))
    known = anchors.join(scores, "uid")
    pairs = chosen.unionByName(_grid(members, known, groups, blocks, negatives, low, high))
    keyed = pairs.rdd.map(lambda p: (packed_key(p[0], p[2], p[3]), (p[1], p[4])))
    ordered = keyed.repartitionAndSortWithinPartitions(width, anchor_of)
    found = ordered.mapPartitions(lambda it: mine(it, positives, negatives, low, high))
    return spark.createDataFrame(found, ddl(RESULT), verifySchema=False)


def anchor_of(key: bytes) -> int:
    """All keys of an anchor go to one partition."""
    return (KEY.unpack(key)[0] * 0x9E3779B97F4A7C15 >> 24) & 0x7FFFFFFF


ORACLE = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS positive,
         list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM kept a JOIN kept r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
best AS (
  SELECT anchor_id, id, score FROM pairs WHERE positive
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT b.anchor_id, b.id AS positive_id,
       row_number() OVER (PARTITION BY b.anchor_id, b.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, b.score AS positive_score, n.score AS negative_score
FROM best b JOIN pairs n ON n.anchor_id = b.anchor_id AND NOT n.positive
  AND 80 * b.score <= 100 * n.score AND 100 * n.score <= 100 * b.score
QUALIFY rank <= 5
"""
