"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in an order shuffled by a hash of their ids. A document finishes when its source, served at the rate
of its target, has sent it: virtual finish time = words of its source up to and with it / target. All
documents are sent in order of finish time until the total budget is used. Second copies follow when a source has been sent
once, up to ``copies`` times. DataFrame functions only.

A hot source is never one group: running totals are taken inside hash buckets of a source and the buckets'
totals are added. The end of the global order is found by narrowing a histogram of finish times, not by sorting all rows
into one task.

Defined cases: a null text has size 0, and documents without words are never taken (taken 0); a null source is
a source of its own; a null doc_id sorts as the empty text; equal finish times are taken together or not at all;
no document whose finish time is over 2 is taken, which only matters for a source with a document far larger than its target.
Rows with the same id are rows of their own, ordered by size; identical ones are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import SPACE_CLASS, fresh_names, quoted, settle

WORD = SPACE_CLASS.replace("[", "[^", 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, copies: int = 2) -> DataFrame:
    """One row per source of ``sizes`` (source, source_size): its rank and its target.

    Targets split ``share`` of all words by weight; none is above ``copies`` times its source, and what
    is over goes to the others by weight. Sources sorted by the level at which they are full make this
    one running sum: the level after the first k are full decides whether the next one is.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    full = ranked.withColumn("weight", weight).withColumn("most", copies * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("full_at", "rank")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = full.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - before) / after)
    open_level = F.max(F.when(F.col("full_at") > F.col("level"), F.col("level"))).over(everything)
    target = F.when(F.col("full_at") <= F.col("level"), F.col("most").cast("double")).otherwise(open_level * F.col("weight"))
    return leveled.select("source", "rank", "source_size", target.alias("target"))


def _cut(copies: DataFrame, budget: float, fan: int = 4096, levels: int = 3) -> float:
    """Largest finish time up to which all copies together are within the budget.

    ``copies`` has columns finish and size. Each pass splits the interval that holds the answer into ``fan`` parts.
    """
    low, width, used = 0.0, 2.0, 0
    for _ in range(levels):
        step = width / fan
        part = F.floor((F.col("finish") - F.lit(low)) / F.lit(step))
        inside = copies.where((F.col("finish") >= low) & (F.col("finish") < low + width))
        sums = sorted((r.part, r.words) for r in inside.groupBy(part.alias("part")).agg(F.sum("size").alias("words")).collect())
        for k, words in sums:
            if used + words > budget:
                low, width = low + k * step, step
                break
            used += words
        else:
            return low + width
    best = low
    inside = copies.where((F.col("finish") >= low) & (F.col("finish") < low + width))
    for finish, words in sorted((r.finish, r.words) for r in inside.groupBy("finish").agg(F.sum("size").alias("words")).collect()):
        if used + words > budget:
            return best if best > low else _below(low)
        used, best = used + words, finish
    return best


def _below(x: float) -> float:
    import math

    return math.nextafter(x, -math.inf)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, copies: int = 2, buckets: int = 4096) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row."""
    sized = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    timed = settle(finish_times(sized, weights, share, copies, buckets), "mix-times")
    return timed.withColumn("taken", taken(timed, share, copies)).drop("first_finish", "rank")


def finish_times(sized: DataFrame, weights: tuple[int, ...], share: float, copies: int, buckets: int, *kept: str, shuffled: Column | None = None) -> DataFrame:
    """Adds source_size, target and first_finish (of the first copy; later ones add source_size / target).

    Documents stand in the order of ``shuffled``, by default a hash of their ids.
    """
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, copies)
    same = F.col("sized.source").eqNullSafe(F.col("sources.source"))
    rows = sized.alias("sized").join(sources.alias("sources"), same).select("sized.*", "sources.rank", "source_size", "target")
    if shuffled is None:
        shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("place", shuffled).withColumn("bucket", _bucket(F.col("place"), buckets))
    order = (F.col("place"), F.col("doc_id").asc_nulls_first(), F.col("size"))
    within = Window.partitionBy("rank", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("rank", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    sent = rows.withColumn("sent", F.sum("size").over(within)).join(parts, ["rank", "bucket"])
    finish = F.when((F.col("size") > 0) & (F.col("target") > 0), (F.col("ahead") + F.col("sent")) / F.col("target"))
    return sent.select("doc_id", "source", "size", "rank", "source_size", "target", finish.alias("first_finish"), *kept)


def _bucket(place: Column, buckets: int) -> Column:
    return F.conv(F.substring(place, 1, 6), 16, 10).cast("long") % buckets


def _finish(copy: int) -> Column:
    """Finish time of a row's copy: the source has been sent ``copy`` times before."""
    return F.col("first_finish") + F.lit(copy) * F.col("source_size") / F.col("target") if copy else F.col("first_finish")


def taken(timed: DataFrame, share: float, copies: int) -> Column:
    """Words of a row that the mix takes, as an expression over ``timed``."""
    return n_taken(timed, share, copies) * F.col("size")


def n_taken(timed: DataFrame, share: float, copies: int) -> Column:
    end = _end(timed, share, copies)
    return F.coalesce(sum((_finish(c) <= F.lit(end)).cast("long") for c in range(copies)), F.lit(0))


def _end(timed: DataFrame, share: float, copies: int) -> float:
    """The finish time up to which the budget lasts."""
    total = timed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    times = F.explode(F.array(*[_finish(c) for c in range(copies)])).alias("finish")
    return _cut(timed.where("first_finish is not null").select("size", times), share * total)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, copies: int = 2, buckets: int = 4096) -> DataFrame:
    """The documents that the mix takes, one row per copy, with the columns of ``docs``.

    What a source sends of a copy is the beginning of its shuffled order, so one (bucket, place) for each source and copy says
    which documents that is: texts are compared with it where they are read, and neither copied nor shuffled. The order comes from the documents' ids and
    texts, not from the layout of the table. Rows with the same id and text share one place, and so are taken together.
    """
    bucket, place, source, size = fresh_names(docs, "bucket", "place", "source", "size")
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = docs.withColumns(
        {
            source: F.col("source").cast("string"),
            size: F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
            place: F.md5(F.concat_ws(" ", id_text, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary")),
        }
    ).withColumn(bucket, _bucket(F.col(place), buckets))
    sized = placed.groupBy(F.col(source).alias("source"), F.col(place).alias("doc_id")).agg(F.sum(size).alias("size"))
    sized = settle(sized, "mix-sizes")
    timed = settle(finish_times(sized, weights, share, copies, buckets, "bucket", shuffled=F.col("doc_id")), "mix-times")
    end = _end(timed, share, copies)
    last = [F.max(F.when(_finish(c) <= F.lit(end), F.struct("bucket", F.col("doc_id").alias("place")))) for c in range(copies)]
    bounds = timed.groupBy(F.col("source").alias("of")).agg(F.array(*last).alias("last"))
    bounds = settle(bounds, "mix-bounds")
    n, of = fresh_names(docs, "n", "of")
    bounds = bounds.select(F.col("of").alias(of), F.col("last").alias(n))
    sent = F.filter(n, lambda t: (F.col(size) > 0) & (F.struct(F.col(bucket).alias("bucket"), F.col(place).alias("place")) <= t))
    times = placed.join(bounds, F.col(source).eqNullSafe(F.col(of))).withColumn(n, F.explode(sent))
    return times.select(*[quoted(c) for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
bucketed AS (SELECT *, ('0x' || substr(place, 1, 6))::BIGINT % 4096 AS bucket FROM sized),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sums),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS most,
         2 * source_size / (CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END) AS full_at
  FROM ranked),
leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
sources AS (
  SELECT source, rank, source_size, CASE WHEN full_at <= level THEN most::DOUBLE
         ELSE (max(CASE WHEN full_at > level THEN level END) OVER ()) * weight END AS target
  FROM leveled),
timed AS (
  SELECT b.doc_id, b.size, s.source_size, s.target,
         CASE WHEN b.size > 0 AND s.target > 0 THEN
           (sum(b.size) OVER (PARTITION BY s.rank ORDER BY b.bucket, b.place, b.doc_id NULLS FIRST, b.size
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / s.target END AS first_finish,
         row_number() OVER () AS n
  FROM bucketed b JOIN sources s ON b.source IS NOT DISTINCT FROM s.source),
copied AS (
  SELECT n, size, first_finish AS finish FROM timed WHERE first_finish IS NOT NULL
  UNION ALL
  SELECT n, size, first_finish + source_size::DOUBLE / target FROM timed WHERE first_finish IS NOT NULL),
running AS (SELECT *, sum(size) OVER (ORDER BY finish RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM copied),
sent AS (
  SELECT n, sum(size)::BIGINT AS taken FROM running
  WHERE finish < 2 AND used <= 1.5::DOUBLE * (SELECT sum(size) FROM timed)::DOUBLE GROUP BY n)
SELECT t.doc_id, t.size, t.source_size, t.target, coalesce(sent.taken, 0)::BIGINT AS taken
FROM timed t LEFT JOIN sent ON t.n = sent.n
"""
