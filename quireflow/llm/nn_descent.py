"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node of the graph. A first graph comes from ``TREES`` or, by the logarithm of their number, more random partitions: nodes are sorted by the
signs of random projections and compared inside runs of ``RUN`` neighbours in that order, so a dense region is cut into more runs, never
into a larger one. Then neighbours of neighbours are joined: all that a node points to, and all that point to it, are
compared with each other where one of the two is new, and a node keeps its ``WIDTH`` best. What points to a popular
node is split by a hash into groups of bounded expected size that are each compared among themselves; no edge is left out. It ends when few edges
change, after however many iterations. Building compares centred vectors of one byte a component; every result is measured on the original
vectors in double precision.

A search starts from its node's neighbours and in each round follows, both ways, the edges of the nearest nodes not yet followed. All
make ``ROUNDS`` rounds; then each goes on until none of its ``BEAM`` nearest nodes is left unfollowed.

Defined cases: null, zero and non-finite vectors, vectors with a null component, a null vec_id, and vectors
of another length than the commonest (ties: the longest) take no part; rows equal in id and vector are one row; ties
in distance go to the smaller vec_id; with fewer candidates than asked for, all that the graph reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import map_rows, settle

TREES, RUN, WIDTH, GROUP = 4, 160, 30, 30  # TREES at least, see trees()
FEW = 0.02
BEAM, ROUNDS, POOL = 40, 7, 400


def trees(n: int) -> int:
    """Random partitions for a first graph of n nodes."""
    return max(TREES, round(np.log2(max(1, n / RUN))))


def _vectors(rows: DataFrame) -> DataFrame:
    """vec_id and x (8 bytes a component) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad & F.exists("x", lambda v: v != 0)
    )
    sizes = good.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    good = good.where(F.size("x") == (sizes[0].n if sizes else 0))

    def pack(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:  # + 0.0 makes -0.0 and 0.0 one value
            yield {"vec_id": batch["vec_id"], "x": [(np.asarray(x, dtype=np.float64) + 0.0).tobytes() for x in batch["x"]]}

    return map_rows(good, "vec_id long, x binary", pack).distinct()


def _shrunk(nodes: DataFrame) -> DataFrame:
    """Nodes with one byte a component about the mean: node, q, scale and squared length."""
    dims = nodes.select(F.octet_length("x").alias("n")).first()
    dims = dims.n // 8 if dims else 0

    def sums(batches: Iterator[dict]) -> Iterator[dict]:
        total, n = np.zeros(dims), 0
        for batch in batches:
            x = np.frombuffer(b"".join(batch["x"]), dtype=np.float64).reshape(-1, dims)
            total, n = total + x.sum(0), n + len(x)
        yield {"total": [total.tolist()], "n": [n]}

    parts = map_rows(nodes.select("x"), "total array<double>, n long", sums).collect()
    mean = sum((np.array(p.total) for p in parts), np.zeros(dims)) / max(1, sum(p.n for p in parts))

    def shrink(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch["x"]), dtype=np.float64).reshape(-1, dims) - mean
            scale = np.maximum(np.abs(x).max(1, initial=0), 1e-300) / 127
            q = np.rint(x / scale[:, None]).astype(np.int8)
            yield {"node": batch["node"], "q": [r.tobytes() for r in q], "scale": scale, "norm": ((q * scale[:, None]) ** 2).sum(1)}

    return map_rows(nodes.select("node", "x"), "node long, q binary, scale double, norm double", shrink)


def _distances(q: list[bytes], scale: list[float], norm: list[float]) -> np.ndarray:
    """Squared distances of all pairs of a group of bounded size."""
    x = np.frombuffer(b"".join(q), dtype=np.int8).reshape(len(q), -1).astype(np.float32)
    s, n = np.array(scale), np.array(norm)
    d = n[:, None] + n - 2 * (x @ x.T) * s[:, None] * s
    np.fill_diagonal(d, np.inf)
    return np.maximum(d, 0)


def _runs(width: int, run: int):
    """Neighbours inside runs of consecutive rows of a sorted partition."""

    def emit(node: np.ndarray, q: list, scale: list, norm: list) -> dict:
        d = _distances(q, scale, norm)
        k = min(width, len(node) - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        return {"u": np.repeat(node, k), "v": node[near].ravel(), "d": np.take_along_axis(d, near, 1).ravel()}

    def over(batches: Iterator[dict]) -> Iterator[dict]:
        held: dict[str, list] = {c: [] for c in ("node", "q", "scale", "norm")}
        for batch in batches:
            for c in held:
                held[c] += batch[c]
            while len(held["node"]) >= 2 * run:
                yield emit(np.array(held["node"][:run]), *(held[c][:run] for c in ("q", "scale", "norm")))
                for c in held:
                    del held[c][:run]
        # The last run takes the rest, up to twice a run, so that no run is small.
        n = len(held["node"])
        if n > 1:
            yield emit(np.array(held["node"]), *(held[c] for c in ("q", "scale", "norm")))

    return over


def _best(edges: DataFrame, width: int) -> DataFrame:
    """The ``width`` nearest of each u; an edge that was there before is not fresh."""
    once = edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    nth = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return once.withColumn("nth", nth).where(F.col("nth") <= width).drop("nth")


def _compare(batches: Iterator[dict]) -> Iterator[dict]:
    """Pairs of a group of which one is fresh and that are nearer than a member's worst neighbour."""
    names = ("center", "part", "m", "fresh", "q", "scale", "norm", "radius")
    held: dict[str, list] = {c: [] for c in names}

    def emit(a: int, b: int) -> list:
        node, fresh = np.array(held["m"][a:b]), np.array(held["fresh"][a:b])
        if b - a < 2 or not fresh.any():
            return []
        d = _distances(held["q"][a:b], held["scale"][a:b], held["norm"][a:b])
        i, j = np.nonzero((d < np.array(held["radius"][a:b])[:, None]) & (fresh[:, None] | fresh))
        keep = node[i] != node[j]
        return [(node[i][keep], node[j][keep], d[i, j][keep])]

    def flush(stop: int) -> Iterator[dict]:
        key = list(zip(held["center"][:stop], held["part"][:stop]))
        cuts = [0, *(i for i in range(1, stop) if key[i] != key[i - 1]), stop]
        for at in range(0, len(cuts) - 1, 256):
            edge = cuts[at : at + 257]
            out = [x for a, b in zip(edge, edge[1:]) for x in emit(a, b)]
            if out:
                u, v, d = (np.concatenate(c) for c in zip(*out))
                yield {"u": u, "v": v, "d": d}
        for c in names:
            del held[c][:stop]

    for batch in batches:
        for c in names:
            held[c] += batch[c]
        # The last group may go on in the next batch.
        stop = len(held["m"])
        last = (held["center"][-1], held["part"][-1]) if stop else None
        while stop and (held["center"][stop - 1], held["part"][stop - 1]) == last:
            stop -= 1
        yield from flush(stop)
    yield from flush(len(held["m"]))


def build_graph(nodes: DataFrame, width: int = WIDTH, seed: int = 11) -> DataFrame:
    """Edges (u, v, d) from each node to its best, d the squared distance of shrunk vectors."""
    small = settle(_shrunk(nodes), "ann-small")
    n = small.count()
    if n < 2:
        return small.select(F.col("node").alias("u"), F.col("node").alias("v"), F.col("norm").alias("d")).where("u <> v")
    dims = small.first().q.__len__()
    bits = max(1, int(np.log2(max(2, n / RUN))) + 1)
    planes = np.random.default_rng(seed).standard_normal((trees(n), bits + 1, dims)).astype(np.float32)

    def place(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch["q"]), dtype=np.int8).reshape(-1, dims).astype(np.float32)
            x *= np.array(batch["scale"], dtype=np.float32)[:, None]
            for t in range(len(planes)):
                p = x @ planes[t].T
                code = ((p[:, :bits] > 0) << np.arange(bits)).sum(1)
                yield {c: batch[c] for c in ("node", "q", "scale", "norm")} | {"tree": [t] * len(x), "code": code, "along": p[:, bits]}

    placed = map_rows(small, "node long, q binary, scale double, norm double, tree int, code long, along float", place)
    parts = max(1, min(4 * small.sparkSession.sparkContext.defaultParallelism, len(planes) * n // (8 * RUN)), len(planes) * n // 100_000)
    dealt = placed.repartitionByRange(parts, "tree", "code", "along", "node").sortWithinPartitions("tree", "code", "along", "node")
    found = map_rows(dealt, "u long, v long, d double", _runs(width, RUN)).where("u <> v").withColumn("fresh", F.lit(True))
    graph = settle(_best(found, width), "ann-graph")
    while True:
        popular = graph.groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
        back = graph.join(popular, "v").select(
            F.col("v").alias("center"),
            F.pmod(F.xxhash64("u", "v"), F.ceil(F.col("degree") / GROUP)).cast("int").alias("part"),
            F.col("u").alias("m"),
            "fresh",
        )
        ahead = graph.select(F.col("u").alias("center"), F.lit(0).alias("part"), F.col("v").alias("m"), "fresh")
        worst = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= width, F.max("d")).otherwise(F.lit(float("inf"))).alias("radius"))
        # Everything of the center meets here: what it points to, and one part of what points to it.
        seen = ahead.unionByName(back).groupBy("center", "part", "m").agg(F.max("fresh").alias("fresh"))
        known = small.join(worst, small.node == worst.u, "left").select(
            F.col("node").alias("m"), "q", "scale", "norm", F.coalesce("radius", F.lit(float("inf"))).alias("radius")
        )
        parts = max(graph.sparkSession.sparkContext.defaultParallelism, 2 * n * width // 400_000)
        groups = seen.join(known, "m").select("center", "part", "m", "fresh", "q", "scale", "norm", "radius")
        groups = groups.repartition(parts, "center", "part").sortWithinPartitions("center", "part", "m")
        new = map_rows(groups, "u long, v long, d double", _compare).withColumn("fresh", F.lit(True))
        graph = settle(_best(graph.withColumn("fresh", F.lit(False)).unionByName(new), width), "ann-graph")
        if graph.where("fresh").count() <= FEW * n * width:
            break
    return graph.select("u", "v", "d")


def _measure(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        n = len(batch["q"])
        a, b = (np.frombuffer(b"".join(batch[c]), dtype=np.float64).reshape(n, -1) for c in ("x_q", "x"))
        yield {"q": batch["q"], "node": batch["node"], "d": np.sqrt(((a - b) ** 2).sum(1)), "followed": [False] * n}


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM, rounds: int = ROUNDS, pool: int = POOL) -> DataFrame:
    """(q, node, d): what the searches from the nodes ``queries`` (q) saw, the ``pool`` nearest of each.

    At least ``rounds`` rounds, and as many more as a search needs until its ``beam`` nearest nodes are all followed.
    """
    both = settle(graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "ann-both")
    asked = settle(queries.join(nodes, queries.q == nodes.node).select("q", F.col("x").alias("x_q")), "ann-asked")
    state = asked.select("q", F.col("q").alias("node"), F.lit(0.0).alias("d"), F.lit(False).alias("followed"))
    for done in count():
        place = F.row_number().over(Window.partitionBy("q").orderBy("d", "node"))
        nth = F.row_number().over(Window.partitionBy("q", "followed").orderBy("d", "node"))
        ahead = F.lit(True)
        if done >= rounds:
            state = state.withColumn("open", ~F.col("followed") & (place <= beam))
            ahead = F.max("open").over(Window.partitionBy("q"))
        go = state.withColumn("go", ~F.col("followed") & (nth <= beam) & ahead)
        marked = settle(go.select("q", "node", "d", (F.col("followed") | F.col("go")).alias("followed"), "go"), "ann-state")
        if done >= rounds and marked.where("go").isEmpty():
            return settle(marked.select("q", "node", "d"), "ann-found")
        steps = marked.where("go").select("q", F.col("node").alias("u")).join(both, "u").select("q", F.col("v").alias("node")).distinct()
        fresh = steps.join(marked.select("q", "node"), ["q", "node"], "left_anti")
        measured = map_rows(fresh.join(nodes, "node").join(asked, "q").select("q", "node", "x_q", "x"), "q long, node long, d double, followed boolean", _measure)
        every = marked.drop("go").unionByName(measured)
        near = F.row_number().over(Window.partitionBy("q").orderBy("d", "node"))
        # The pool bounds a search's memory as its beam bounds its work; far nodes would not be followed.
        state = every.withColumn("near", near).where(F.col("near") <= pool).drop("near")


def nearest(rows: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The ``k`` nearest found of every row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    vectors = settle(_vectors(rows), "ann-vectors")
    nodes = settle(vectors.groupBy("x").agg(F.min("vec_id").alias("node")).select("node", "x"), "ann-nodes")
    # Of equal vectors, the k + 1 smallest ids are all that any answer needs.
    nth = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    copies = vectors.withColumn("nth", nth).where(F.col("nth") <= k + 1).join(nodes, "x").select("node", "vec_id")
    copies = settle(copies, "ann-copies")
    wanted = settle(vectors.where(F.col("vec_id") % every == 0).join(nodes, "x").select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")), "ann-queries")
    found = search(nodes, build_graph(nodes), wanted.select("q").distinct())
    # Copies of one vector share a search; answers are cut per search before they meet the queries.
    named = found.join(copies, "node").select("q", "vec_id", "d")
    nth = F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))
    named = named.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    answers = wanted.join(named, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))
