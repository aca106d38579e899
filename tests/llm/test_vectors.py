"""Operators on vectors, against plain loops."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.llm import ORACLES, QUERIES, hard_negatives, lloyd

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, __id long, g int, anchor string, `a``b` int, s struct<`f-g`:int>"


@pytest.fixture(scope="module")
def vectors(spark):
    """Odd rows among ordinary ones: nulls anywhere, ties, repeats, other lengths, huge components, clashing columns."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], rng.choice([0, 1, 2, None])) for i in range(300)]
    rows += [(300 + i, [0.25] * 8, 1) for i in range(40)] + [(400, [0.5, -0.5] * 4, 3)] * 3
    rows += [
        (500, None, 1), (501, [0.1, None] * 4, 1), (502, [math.nan] * 8, 1), (503, [math.inf] * 8, 2), (None, [0.3] * 8, 1), (None, [0.3] * 8, None),
        (700, [], 2), (800, [0.5, 0.25], 2), (2**53 + 1, [0.125] * 8, 0), (-700, [0.2] * 8, 1), (900, [3.0e38] + [0.0] * 7, 2), (100, [0.9] * 8, 1),
    ]
    return spark.createDataFrame([(*r, 1, 2, "x", 3, (4,)) for r in rows], SCHEMA).repartition(5)


def whole_rows(table, scale, bound):
    out = []
    for r in table.collect():
        if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding):
            ints = [min(max(math.floor(scale * x), -bound), bound) for x in r.embedding]
            out.append((r.vec_id, ints + [0] * (8 - len(ints)), r.label))
    return out


def brute_lloyd(rows, entries, rounds=4):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = [[tuple(r[1][2 * p : 2 * p + 2]) for r in rows] for p in range(4)]
    books = [[list(x) for x in part[:entries]] for part in parts]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for part, book in zip(parts, books, strict=True):
            held = {}
            for x in part:
                held.setdefault(best(x, book)[1], []).append(x)
            for e, members in held.items():
                book[e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for i, r in enumerate(rows):
        found = [best(part[i], book) for part, book in zip(parts, books, strict=True)]
        out.append((r[0], "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), r[2]))
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return out, digest


@pytest.mark.parametrize("entries", [7, 256])
def test_lloyd_matches_plain_loops(vectors, entries):
    want, digest = brute_lloyd(whole_rows(vectors, 1024, lloyd.largest_step(8, 4)), entries)
    sums = {}
    for _, _, error, label in want:
        sums[label] = min(sums.get(label, 0) + error, 2**63 - 1)
    found = lloyd.report(lloyd.compress(vectors, entries=entries)).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, found)) == sorted(key((v, c, e, sums[lab], digest)) for v, c, e, lab in want)


def test_lloyd_does_not_depend_on_the_layout(spark, vectors):
    rows = [sorted(map(repr, lloyd.report(lloyd.compress(t, entries=20)).collect())) for t in (vectors.coalesce(1), vectors.repartition(9))]
    assert rows[0] == rows[1]
    empty = lloyd.report(lloyd.compress(vectors.limit(0)))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert lloyd.compress(vectors.where("vec_id = 700")).rows.collect()[0].code == "00000000"


def test_only_parts_that_change_owner_are_shuffled():
    rng = np.random.default_rng(0)
    books = rng.integers(-50, 50, (4, 16, 2))
    owners = lloyd.Owners(np.ones((4, 16), dtype=np.int64), 6)
    values, tokens = rng.integers(-60, 60, (500, 2)), rng.integers(0, 2**32, 500, dtype=np.uint32)
    entries = lloyd.nearest(values, books[2])[0]
    resident = list(lloyd.dealt(2, entries, tokens, values, owners.of(2, entries, tokens)))
    # With the same codebooks nothing moves; with another one, what moves are parts of other entries.
    for k, block in resident:
        again = list(lloyd.reassigned(books, owners)(iter([(k, block)])))
        assert [x[0] for x in again] == [k] and not list(lloyd.moving(k, again))
        other = books + rng.integers(-9, 9, books.shape)
        moved = [x for b in lloyd.moving(k, list(lloyd.reassigned(other, owners)(iter([(k, block)])))) for x in map(tuple, b[1][3].tolist())]
        changed = [tuple(v) for v, e in zip(block[3].tolist(), block[1], strict=True) if lloyd.nearest(np.array([v]), other[2])[0][0] != e]
        assert len(moved) <= len(changed) and set(moved) <= set(changed)


def test_hot_entries_get_salts():
    owners = lloyd.Owners(np.ones((1, 4), dtype=np.int64), 10).grown(np.array([[900_000, 10, 0, 5]]))
    assert owners.salts.tolist() == [[1 + 900_000 // (900_015 // 40), 1, 1, 1]]
    spread = owners.of(0, np.zeros(900, dtype=np.int64), np.arange(900, dtype=np.uint32))
    assert len(set(spread.tolist())) == 10
    assert (owners.grown(np.array([[5, 5, 5, 5]])).salts == owners.salts).all()


def brute_negatives(rows, bound, k=5, low=80, high=100):
    rows = [(v, x, lab) for v, x, lab in rows if lab is not None]
    order = lambda s, v: (-s, v is None, v or 0)
    out = []
    for i, (anchor, x, lab) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, y, strict=True)), v, lab2) for j, (v, y, lab2) in enumerate(rows) if j != i]
        tops = sorted([(s, v) for s, v, m in scored if m == lab], key=lambda t: order(*t))[:k]
        for score, v in tops:
            found = sorted([(s, n) for s, n, m in scored if m != lab and low * score <= high * s <= high * score], key=lambda t: order(*t))[:k]
            out += [(anchor, v, r + 1, n, score, s) for r, (s, n) in enumerate(found)]
    return out


def test_hard_negatives_match_plain_loops(spark, vectors):
    bound = hard_negatives.largest_step(8, 200)
    want = sorted(map(repr, brute_negatives(whole_rows(vectors, 256, bound), bound)))
    for table in (vectors, vectors.coalesce(1)):
        found = hard_negatives.hard_negatives(table, F.col("vec_id") % 100 == 0).collect()
        assert sorted(repr(tuple(r)) for r in found) == want
    assert hard_negatives.hard_negatives(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_hard_negatives_in_small_cells(spark, vectors, monkeypatch):
    table = vectors.where("vec_id is not null")
    want = sorted(map(repr, hard_negatives.hard_negatives(table, F.col("vec_id") % 5 == 0).collect()))
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 29)
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", 13)
    assert sorted(map(repr, hard_negatives.hard_negatives(table, F.col("vec_id") % 5 == 0).collect())) == want


def test_packed_keys_keep_the_order():
    keys = [(a, -s, v is None, v or 0, hard_negatives.packed_key(a, s, v)) for a in (0, 2**40) for s in (-(2**60), -1, 0, 7, 2**60) for v in (-5, 0, 2**62, None)]
    assert [k[4] for k in sorted(keys)] == sorted(k[4] for k in keys)
    assert {hard_negatives.unpacked_key(k[4]) for k in keys} == {(a, -s, None if n else v) for a, s, n, v, _ in keys}


@pytest.mark.parametrize("name", ["op11_member_resident_lloyd", "op12_hard_negatives"])
def test_vector_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(ORACLES[name])
    found = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, found)) == sorted(want.fetchall())
