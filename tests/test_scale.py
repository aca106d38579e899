"""Hot keys: same results as the plain form, and no task or row that holds the whole group."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quireflow import CollectionSpec, Field
from quireflow.catalog import QUERIES
from quireflow.operators import digests, joins, nested, objects

N = 6000


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share the key 0."""
    return spark.range(N).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000).alias("k")
    )


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_chained_joins_plan_each_side_once(spark, hot, tmp_path):
    hot.write.parquet(str(tmp_path / "rows"))
    spark.range(2000).selectExpr("id AS k").write.parquet(str(tmp_path / "keys"))
    right = spark.read.parquet(str(tmp_path / "keys"))
    joined = spark.read.parquet(str(tmp_path / "rows"))
    counts = []
    for i in range(4):
        joined = joins.key_join(joined, right.withColumn(f"v{i}", F.lit(i)), ["k"], "left")
        counts.append(scans(joined))
    assert counts == [2, 3, 4, 5]


@pytest.mark.parametrize("name, most", [("jn_or_exists", 6), ("tch_ancestors", 8), ("obj_lifecycle", 5)])
def test_snapshots_are_scanned_few_times(spark, name, most):
    assert scans(QUERIES[name](spark, "/root/testdata/sf0.001")) <= most


def test_short_digest_of_the_sample_strings(spark):
    df = spark.createDataFrame([("g", s) for s in ("sakana_zaurus", "koneko_zaurus", "sakana_wanko")], "g string, s string")
    assert digests.shortest_unique_length(df, "g", "s").collect()[0].short_len == 8
    one = spark.createDataFrame([("g", "only")], "g string, s string")
    assert digests.with_short_digest(one, "g", "s").collect()[0].short == "o"


def test_short_digest_equals_all_neighbours(spark):
    values = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(400)]
    values += [values[0][:20] + "0" * 44, values[1][:6] + "f" * 58]
    groups = {"big": values, "pair": ["ab", "abc"], "twins": ["same", "same"], "far": ["x1", "y1"]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    got = {
        r.g: r.short_len
        for r in digests.shortest_unique_length(spark.createDataFrame(rows, "g string, s string"), "g", "s").collect()
    }

    def shared(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for g, vs in groups.items():
        ordered = sorted(vs)
        assert got[g] == max(shared(a, b) for a, b in zip(ordered, ordered[1:])) + 1, g


LIB = CollectionSpec(
    name="c",
    table="docs",
    schema=(
        ("id", Field("id")),
        ("rows", Field("records", table="rows", inherit_ids=("doc",), schema=(("row", Field("id")), ("v", Field("integer"))))),
    ),
)


def test_renest_splits_a_huge_parent_and_loses_nothing(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("empty",)], "id string")
    kids = spark.range(N).select(
        F.when(F.col("id") < N - 3, "a").otherwise("b").alias("doc"),
        F.concat(F.lit("r"), F.col("id")).alias("row"),
        F.col("id").alias("v"),
        F.col("id").cast("int").alias(nested.POS),
    )
    out = nested.renest(docs, kids, ["id"], LIB.tables()["rows"], "rows", target=500).collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append(r)
    assert len(by["a"]) == 12 and all(len(r.rows) < 700 for r in by["a"])
    assert sorted(x.v for r in by["a"] for x in r.rows) == list(range(N - 3))
    assert all([x.v for x in r.rows] == sorted(x.v for x in r.rows) for r in by["a"])
    assert (by["b"][0].parts, len(by["b"][0].rows)) == (1, 3)
    assert by["empty"][0].rows is None and by["empty"][0].part == 0


def test_nested_arrays_flatten_and_come_back(spark):
    docs = spark.sql("SELECT 'd' AS id, array(named_struct('row','r1','v',1L), named_struct('row','r2','v',2L)) AS rows")
    tables = nested.flatten(docs, LIB)
    back = nested.renest(tables["docs"], tables["rows"], ["id"], LIB.tables()["rows"], "rows").collect()[0]
    assert [(r.row, r.v) for r in back.rows] == [("r1", 1), ("r2", 2)]
    with pytest.raises(ValueError, match="inherit_ids"):
        nested.explode_children(docs, ["id", "x"], "rows", LIB.tables()["rows"])


def test_kv_batches_are_bounded_and_whole(spark):
    pairs = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, "small").when(F.col("id") == 1, None).otherwise("big").alias("namespace"),
        F.concat(F.lit("k"), F.col("id")).alias("key"),
        F.repeat(F.lit("v"), F.when(F.col("id") % 500 == 7, 3000).otherwise((F.col("id") % 90).cast("int"))).alias("value"),
        F.lit(False).alias("base64"),
        (F.col("id") * 10).alias("expiration"),
    )
    for target, most in ((400, 10**9), (10**6, 4000), (50, 4000)):
        out = objects.kv_batches(pairs, target=target, max_bytes=most).collect()
        assert len({(r.namespace, r.batch) for r in out}) == len(out)
        assert sum(len(r.pairs) for r in out) == N and {r.namespace for r in out} == {"small", "big", None}
        assert max(len(r.pairs) for r in out) <= target
        for r in out:
            size = sum(len(p.key) + len(p.value) for p in r.pairs)
            assert size <= most and (r.batch >= 0 or (len(r.pairs) == 1 and size > most // 2))
            assert all(p.expiration == int(p.key[1:]) * 10 for p in r.pairs)
        assert len({p.key for r in out for p in r.pairs}) == N
        # Batches are well filled: there are at most some more than their bounds ask for.
        total = sum(len(p.key) + len(p.value) for r in out for p in r.pairs)
        assert len(out) <= 4 + N / target + 2 * total / (most // 2) + 12
    gone = objects.delete_batches(pairs.select("namespace", "key"), target=400).collect()
    assert sum(len(r.keys) for r in gone) == N and max(len(r.keys) for r in gone) <= 400
