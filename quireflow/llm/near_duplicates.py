"""Near-duplicate groups by MinHash bands and sequential Bayesian verification.

A document is the set of its ``width``-word shingles. Documents with equal sets are one class, found by a digest of
the set. Classes that agree in one of ``BANDS`` bands of their signatures are candidates: at a similarity of 0.8 one
pair in twenty million shares no band. Signatures of candidates are compared in batches; after each batch the
posterior chance that the pair is similar enough, under a uniform prior, is bounded by a binomial tail, and the pair is dropped
when it is below ``MISS``. What survives is confirmed on the full sets, so a link is never wrong.

Hot bands are not expanded into all pairs. Every member is compared with its band's smallest document first, and linked documents
are joined into components. Only bands that still hold several components go on: twice a member of another component is the
one that all are compared with. Then each band is charged to the component that most of its members are in, and all others of its bands, the
probes, are compared with everything charged to that component, in blocks of bounded expected size, so that no link between different
components is lost and no list of pairs is made.

Defined cases: texts without words (null, empty) have an empty set and are linked with nothing; a row without doc_id
is linked with nothing and has no component; rows with the same doc_id are one document; ties go to the smaller doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.common import fresh_names, map_rows, settle, words_of

BANDS, DEPTH, BATCH = 32, 4, 16
HASHES = BANDS * DEPTH
MISS = 1e-6
ROUNDS = 2
#: Rows that a task takes before more tasks are made: documents (texts, signatures, pairs), and edges of two numbers.
ROWS, EDGES = 4096, 1 << 17

_draw = np.random.default_rng(20240607)
_FACTORS = _draw.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint32(0x9E3779B1)
#: Bytes of one value of a signature.
VALUE = 2


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of the whole sequence if it is shorter."""
    words = words_of(text)
    x = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(x):
        return x
    span = min(width, len(x))
    n = len(x) - span + 1
    out = np.full(n, span, dtype=np.uint64)
    for i in range(span):
        out = (out ^ x[i : i + n]) * _BASE
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    """Minima of HASHES multiply-shift hashes, each folded to 16 bits.

    Equal minima stay equal. Different ones agree by chance once in 65,536, which adds candidates and drops none.
    """
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(shingles), block):
        x = shingles[at : at + block]
        low = np.minimum(low, ((_FACTORS[:, None] * x + _SHIFTS[:, None]) >> np.uint64(32)).min(1).astype(np.uint32))
    return ((low * _FOLD) >> np.uint32(16)).astype(np.uint16)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """Matches needed after each batch: with fewer, the posterior of similarity is below ``miss``.

    Under a uniform prior, after m matches of n, it is the chance of at most m successes in n + 1 trials.
    """
    rate, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * rate**m * (1 - rate) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def _sign(width: int):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, len(batch["text"]), 512):
                out: dict[str, list] = {"doc_id": batch["doc_id"][at : at + 512], "n_shingles": [], "digest": [], "signature": []}
                for text in batch["text"][at : at + 512]:
                    x = shingle_set(text, width)
                    out["n_shingles"].append(len(x))
                    out["digest"].append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                    out["signature"].append(signature(x).tobytes() if len(x) else None)
                yield out

    return run


def _prune(percent: int):
    need = least_matches(percent)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c]), dtype=np.uint16).reshape(-1, HASHES) for c in ("sign_a", "sign_b"))
            left, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
            for k, least in enumerate(need):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (a[left, part] == b[left, part]).sum(1)
                good = matches >= least
                left, matches = left[good], matches[good]
            yield {"a": [batch["a"][i] for i in left], "b": [batch["b"][i] for i in left]}

    return run


def _blocks(width: int, percent: int):
    """Links between probes and others of a block: signatures first, in batches, then full sets."""
    need = least_matches(percent)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        probes, members = rows[rows["probe"]], rows[~rows["probe"]]
        sign = [np.frombuffer(b"".join(x["signature"]), dtype=np.uint16).reshape(-1, HASHES) for x in (probes, members)]
        own = [x["component"].to_numpy() for x in (probes, members)]
        rep = [x["rep"].to_numpy() for x in (probes, members)]
        text = [x["text"].tolist() for x in (probes, members)]
        sets: list[dict] = [{}, {}]
        out = []
        for i in range(len(probes)):
            left, matches = np.flatnonzero(own[1] != own[0][i]), 0
            for k, least in enumerate(need):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (sign[1][left, part] == sign[0][i, part]).sum(1)
                good = matches >= least
                left, matches = left[good], matches[good]
            for j in left.tolist():
                for side, at in ((0, i), (1, j)):
                    if at not in sets[side]:
                        sets[side][at] = shingle_set(text[side][at], width)
                if similar(sets[0][i], sets[1][j], percent):
                    out.append((min(rep[0][i], rep[1][j]), max(rep[0][i], rep[1][j])))
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype="int64")

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known, own = None, None
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
                if known != (a, text_a):  # rows come by a, so a hot document is hashed once
                    known, own = (a, text_a), shingle_set(text_a, width)
                if similar(own, shingle_set(text_b, width), percent):
                    out["a"].append(a)
                    out["b"].append(b)
            yield out

    return run


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for so many rows: the cores there are, and more once a task would get over ``each`` rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def components(edges: DataFrame, purpose: str = "links") -> DataFrame:
    """node, component (smallest node reachable) of every node of ``edges`` (a, b).

    Alternates large-star and small-star steps until every node has one edge at most to a smaller node, and that one none; each step is
    settled. A step has no more rows than the edges, so their number says how many tasks take a step's rows.
    """
    n = tasks_for(edges.sparkSession, edges.count(), EDGES)
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(n), purpose)
    while True:
        ends = now.select(F.col("a").alias("node"), "b").unionByName(now.select(F.col("b").alias("node"), "b"))
        label = settle(ends.groupBy("node").agg(F.min("b").alias("component"), F.max("b").alias("high")).coalesce(n), purpose)
        if label.where("component < high").isEmpty():
            return label.select("node", "component")
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        large = large.coalesce(n).distinct().coalesce(n)
        small = large.groupBy("a").agg(F.min("b").alias("low"))
        # A node's edge to its smallest neighbour stays; the other neighbours get one to it.
        step = large.join(small.hint("merge"), "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        now = settle(step.coalesce(n), purpose)


class Links:
    """Confirms candidate pairs of class representatives.

    Only members of shared bands are ever compared. Their texts are picked out of the corpus once, for all rounds. Joins run in
    ``tasks`` tasks at most.
    """

    def __init__(self, docs: DataFrame, members: DataFrame, classes: DataFrame, width: int, percent: int, tasks: int):
        texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        kept = texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        self.texts = settle(kept.coalesce(tasks), "near-texts")
        self.classes, self.width, self.percent, self.tasks = classes, width, percent, tasks

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        signs = self.classes.select("rep", "signature")
        signed = self._join(pairs, signs.select(F.col("rep").alias("b"), F.col("signature").alias("sign_b")), "b")
        signed = self._join(signed, signs.select(F.col("rep").alias("a"), F.col("signature").alias("sign_a")), "a")
        left = settle(map_rows(signed, "a long, b long", _prune(self.percent)).distinct().coalesce(self.tasks), "near-survivors")
        texts = self.texts
        full = self._join(left, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        full = self._join(full, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return settle(map_rows(full, "a long, b long", _confirm(self.width, self.percent)), "near-links")

    def _join(self, left: DataFrame, right: DataFrame, on: str) -> DataFrame:
        return left.join(right, on).coalesce(self.tasks)

    def between(self, open_: DataFrame, block: int = 1024) -> DataFrame:
        """Links between different components of the bands in ``open_`` (band, rep, component)."""
        sizes = open_.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
        home = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("home"))
        charged = settle(open_.join(home, "band").select("home", "rep", "component").distinct().coalesce(self.tasks), "near-charged")
        probes = F.sum((F.col("component") != F.col("home")).cast("long"))
        parts = charged.groupBy("home").agg(
            F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_parts"), F.ceil(4 * probes / block).cast("int").alias("n_turns")
        )
        full = charged.join(parts, "home").join(self.classes.select("rep", "signature"), "rep")
        full = full.join(self.texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
        deal = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        columns = ("home", "part", "turn", "rep", "component", "signature", "text", "probe")
        members = full.withColumn("part", deal("n_parts", 1)).withColumn("turn", every("n_turns")).withColumn("probe", F.lit(False))
        asking = full.where("component <> home").withColumn("turn", deal("n_turns", 2)).withColumn("part", every("n_parts"))
        rows = members.select(*columns).unionByName(asking.withColumn("probe", F.lit(True)).select(*columns))
        links = rows.groupBy("home", "part", "turn").applyInPandas(_blocks(self.width, self.percent), "a long, b long")
        return settle(links.distinct().coalesce(self.tasks), "near-links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row: one document of each group is kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = settle(map_rows(rows, "doc_id long, n_shingles long, digest binary, signature binary", _sign(width)), "near-signed")
    usable = signed.where("doc_id is not null and digest is not null")
    # What each step makes, in as many tasks as the documents need: a shuffle's parts are many and mostly small.
    tasks = tasks_for(docs.sparkSession, signed.count(), ROWS)
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    classes = settle(classes.coalesce(tasks), "near-classes")
    bands = classes.select(
        "rep",
        F.explode(
            F.array(*[F.xxhash64(F.lit(i), F.substring("signature", VALUE * DEPTH * i + 1, VALUE * DEPTH)) for i in range(BANDS)])
        ).alias("band"),
    )
    # A band with one class links nothing; the others keep all their members.
    shared = bands.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    members = settle(bands.join(shared.select("band", "low"), "band").coalesce(tasks), "near-bands")
    links = Links(docs, members, classes, width, percent, tasks)
    first = members.where("low <> rep").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    done = settle(first.coalesce(tasks), "near-pairs")
    # A document of several classes (a repeated id) ties them together.
    found = links.confirm(done)
    again = settle(usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id").coalesce(tasks), "near-again")
    if not again.isEmpty():
        own = usable.select("doc_id", "digest").join(again, "doc_id", "left_semi").join(classes.select("digest", "rep"), "digest")
        torn = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).where("a < high")
        tied = own.join(torn.select("doc_id", "a"), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))
        found = found.unionByName(settle(tied.coalesce(tasks), "near-ties"))
    label = components(found)
    for turn in range(rounds + 1):
        named = members.select("band", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep")
        )
        mixed = named.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
        open_ = settle(named.join(mixed, "band").coalesce(tasks), "near-open")
        if open_.isEmpty():
            break
        if turn == rounds:
            more = links.between(open_)
        else:
            # A pivot of another component than the first: the smallest member outside it, then, in turn, of the last one.
            pivot = open_.where(F.col("component") != F.col("c0") if turn % 2 == 0 else F.col("component") == F.col("c1"))
            pivot = pivot.groupBy("band").agg(F.min("rep").alias("a"), F.min_by("component", "rep").alias("own"))
            new = open_.join(pivot, "band").where("component <> own").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b"))
            new = settle(new.distinct().join(done, ["a", "b"], "left_anti").coalesce(tasks), "near-pairs")
            done = done.unionByName(new)
            more = links.confirm(new)
        if not more.isEmpty():
            found = found.unionByName(more)
            label = components(found)
    named = classes.select("digest", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("digest", F.coalesce("component", "rep").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select("doc_id", "n_shingles", own)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group left, all columns kept; rows without doc_id stay.

    Of rows that share a kept doc_id, one stays.
    """
    groups = settle(near_duplicates(docs, width, percent), "near-groups")
    gone_id, times = fresh_names(docs, "id", "n")
    own = F.col("doc_id").cast("long")
    gone = groups.where("doc_id is not null and not kept").select(F.col("doc_id").alias(gone_id)).distinct()
    # Removed ids are the smaller set, but grow with the table: the join is a shuffle on any size.
    rest = docs.join(gone.hint("merge"), own == F.col(gone_id), "left_anti")
    repeated = groups.where("kept").groupBy(F.col("doc_id").alias(gone_id)).agg(F.count(F.lit(1)).alias(times)).where(F.col(times) > 1)
    repeated = settle(repeated.select(gone_id), "near-repeated")
    if repeated.isEmpty():
        return rest
    # Only rows whose id comes again pay for a second shuffle.
    again = rest.join(repeated, own == F.col(gone_id), "left_semi")
    return rest.join(repeated, own == F.col(gone_id), "left_anti").unionByName(again.dropDuplicates(["doc_id"]))
