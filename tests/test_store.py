"""The store: commits over several tables, buckets, deltas, digests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quireflow.operators import diff
from quireflow.plans import apply
from quireflow.sinks import snapshots
from quireflow.sinks.snapshots import BUCKET, Conflict, SnapshotStore
from quireflow.specs import CollectionSpec, Field
from quireflow.streaming import incremental

SPECS = CollectionSpec(
    name="shop",
    table="baskets",
    schema=(
        ("basket", Field("id")),
        ("owner", Field("string")),
        ("moved", Field("updated_at")),
        ("goods", Field("records", table="goods", inherit_ids=("of_basket",), schema=(("item", Field("id")), ("n", Field("integer"))))),
    ),
).tables()
T0, T1 = "2025-01-01 00:00:00", "2025-02-02 00:00:00"


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "s"), buckets=8)


def shop(spark, n, change=None):
    baskets = [(f"b{i}", f"o{i}") for i in range(n)]
    goods = [(f"b{i}", f"g{k}", 100 * i + k + (100_000 if change == (i, k) else 0)) for i in range(n) for k in range(3)]
    return {"baskets": spark.createDataFrame(baskets, "basket string, owner string"), "goods": spark.createDataFrame(goods, "of_basket string, item string, n long")}


def test_readers_see_all_tables_of_a_run_or_none(spark, store):
    run = store.begin()
    run.replace("a", spark.range(4), ["id"])
    run.replace("b", spark.range(4), ["id"])
    run.commit()
    # A run that stops between two tables has staged the first one only.
    stopped = store.begin()
    stopped.replace("a", spark.range(9), ["id"])
    assert store.read("a").count() == store.read("b").count() == 4 and store.at().version == 1
    stopped.replace("b", spark.range(9), ["id"])
    assert stopped.commit() == 2
    assert store.read("a").count() == store.read("b").count() == 9
    assert store.at(1).read("a").count() == 4 and store.versions("a") == [1, 2]


def test_a_sync_that_dies_between_tables_leaves_the_old_state(spark, store, monkeypatch):
    apply.sync_store(store, SPECS, shop(spark, 12), T0)
    replaced = snapshots.Run.replace

    def dying(self, table, *args, **kwargs):
        if table == "goods":
            raise RuntimeError("lost")
        return replaced(self, table, *args, **kwargs)

    monkeypatch.setattr(snapshots.Run, "replace", dying)
    with pytest.raises(RuntimeError, match="lost"):
        apply.sync_store(store, SPECS, shop(spark, 12, change=(3, 1)), T1)
    assert store.at().version == 1
    assert store.read("baskets").where(F.col("moved") == F.lit(T1).cast("timestamp")).count() == 0
    assert store.read("goods").where("n >= 100000").count() == 0


def test_conflicts_are_per_table(spark, store):
    first, second, third = store.begin(), store.begin(), store.begin()
    first.replace("a", spark.range(1))
    second.replace("b", spark.range(2))
    third.replace("a", spark.range(3))
    assert first.commit() == 1 and second.commit() == 2
    assert store.read("a").count() == 1 and store.read("b").count() == 2
    with pytest.raises(Conflict, match="'a'"):
        third.commit()
    assert store.read("a").count() == 1


def test_a_commit_that_is_not_whole_does_not_count(spark, store, tmp_path):
    store.write("a", spark.range(3))
    (tmp_path / "s/_log/000000000002.json").write_text('{"tables": {"a":')
    assert store.at().version == 1 and store.read("a").count() == 3
    store.write("a", spark.range(5))
    assert store.at().version == 3 and store.read("a").count() == 5


def test_a_run_writes_only_buckets_that_differ(spark, store, tmp_path):
    tables = shop(spark, 40)
    apply.sync_store(store, SPECS, tables, T0)
    before = store.at()
    after = apply.sync_store(store, SPECS, shop(spark, 40, change=(7, 2)), T1)
    now = store.at()
    for name in SPECS:
        old, new = before.tables[name], now.tables[name]
        fresh = {f: b for f, b in new.live.items() if f not in old.live}
        assert sum(map(len, fresh.values())) == 1, "one bucket of each table: the changed row's, and its basket's"
        folders = list((tmp_path / "s").glob(f"{next(iter(fresh))}/{BUCKET}=*"))
        assert len(folders) == 1
    assert after["goods"].where("n = 100702").count() == 1 and after["goods"].count() == 120
    moved = {r.basket for r in after["baskets"].where(F.col("moved") == F.lit(T1).cast("timestamp")).collect()}
    assert moved == {"b7"} and after["baskets"].count() == 40
    # Nothing differs: nothing is written and nothing is committed.
    apply.sync_store(store, SPECS, shop(spark, 40, change=(7, 2)), T1)
    assert store.at().version == now.version
    gone = apply.sync_store(store, SPECS, {n: t.limit(0) for n, t in tables.items()}, T1)
    assert all(t.count() == 0 for t in gone.values())


def test_a_feed_reads_only_buckets_that_differ(spark, store):
    spec = SPECS["goods"]
    run = store.begin()
    run.replace("goods", shop(spark, 40)["goods"], spec.pk, by=["of_basket"])
    run.commit()
    feed = apply.changed_rows(store, spec, shop(spark, 40, change=(7, 2))["goods"])
    assert [tuple(r) for r in feed.collect()] == [("b7", "g2", diff.UPDATE)]
    # Both sides prune their folders; what the stored side reads lies in one bucket.
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"PartitionFilters: [isnotnull({BUCKET}") >= 2, plan
    view = store.at()
    dirty = view.tables["goods"].dirty(snapshots.bucket_digests(_bucketed(shop(spark, 40, change=(7, 2))["goods"]), ["of_basket", "item", "n"]))
    files = view.read("goods", dirty).select(F.input_file_name().alias("f")).distinct().collect()
    assert len(dirty) == 1 and len({f.f.split(f"{BUCKET}=")[1].split("/")[0] for f in files}) == 1 < len(view.tables["goods"].digests)


def _bucketed(rows):
    return rows.withColumn(BUCKET, snapshots.bucket_of(["of_basket"], 8))


def test_digests_tell_swapped_values_and_nulls_apart(spark):
    rows = lambda *r: spark.createDataFrame([(0, *x) for x in r], f"{BUCKET} int, a string, b string")
    sets = [[("x", None)], [(None, "x")], [("x", "x")], [("x", None), ("x", None)], [(None, None)], []]
    assert len({str(snapshots.bucket_digests(rows(*s), ["a", "b"])) for s in sets}) == len(sets)
    assert snapshots.bucket_digests(rows(("p", "q"), ("r", "s")), ["a", "b"]) == snapshots.bucket_digests(rows(("r", "s"), ("p", "q")), ["a", "b"])


def test_streams_append_deltas_and_rewrite_touched_buckets(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MAX_DELTAS", 3)
    spec = SPECS["baskets"]

    def batch(rows, stamp):
        run = store.begin()
        incremental.merge_batch(run, spec, spark.createDataFrame(rows, "basket string, owner string"), stamp)
        run.commit()

    want = {f"b{i}": (f"o{i}", T0) for i in range(50)}
    batch([(k, o) for k, (o, _) in want.items()], T0)
    for k in range(7):
        rows = [(f"b{k}", f"new{k}"), (f"b{k + 20}", f"o{k + 20}"), (f"c{k}", "fresh")]
        batch(rows, T1)
        want |= {f"b{k}": (f"new{k}", T1), f"c{k}": ("fresh", T1)}
        state = store.at().tables["baskets"]
        assert len(state.deltas) < 3
        got = {r.basket: (r.owner, str(r.moved)) for r in store.read("baskets").collect()}
        assert got == want
    # A batch that comes again writes nothing.
    version = store.at().version
    batch([("b3", "new3"), ("c1", "fresh")], "2026-01-01 00:00:00")
    assert store.at().version == version
    written = sum(len(b) for f, b in state.live.items()) + sum(len(b) for b in state.deltas.values())
    assert written <= 8 + 3 * 2


def test_vacuum_keeps_what_the_last_commits_name(spark, store, tmp_path):
    for n in (3, 4, 5):
        store.write_all({"a": spark.range(n), "b": spark.range(n)}, {"a": ["id"]})
    stopped = store.begin()
    stopped.replace("a", spark.range(1), ["id"])
    assert store.vacuum(keep=2) and store.at(2).read("a").count() == 4
    assert len(list((tmp_path / "s/a").glob("data-*"))) == 4, "young files stay"
    store.vacuum(keep=1, grace=-10)
    assert len(list((tmp_path / "s/a").glob("data-*"))) == len(list((tmp_path / "s/b").glob("data-*"))) == 1
    assert store.read("a").count() == store.read("b").count() == 5
    with pytest.raises(ValueError, match="no commit"):
        store.at(1)


def test_other_keys_or_columns_are_written_as_a_whole(spark, store):
    store.write("a", spark.range(4), ["id"])
    run = store.begin()
    with pytest.raises(ValueError, match="as a whole"):
        run.replace("a", spark.range(2).withColumn("x", F.lit(1)), ["id"], touched=[0])
    run.replace("a", spark.range(2).withColumn("x", F.lit(1)), ["id"])
    run.commit()
    assert store.read("a").columns == ["id", "x"]
    with pytest.raises(ValueError, match="no stored state"):
        store.begin().append("b", spark.range(1))


def test_a_first_sync_stages_and_compares_nothing(spark, tmp_path, monkeypatch):
    """An empty store holds nothing to compare with: the rows are shuffled and written once."""
    specs = CollectionSpec(name="p", table="p", schema=(("id", Field("id")), ("n", Field("integer")), ("updated_at", Field("updated_at")))).tables()
    rows = spark.createDataFrame([("a", 1), ("b", None)], "id string, n long")
    store = SnapshotStore(spark, str(tmp_path), buckets=4)
    with monkeypatch.context() as m:
        m.setattr(apply, "_cut", None)
        apply.sync_store(store, specs, {"p": rows}, "2025-01-01 00:00:00")
    after = apply.sync_store(store, specs, {"p": rows.where("id = 'a'").selectExpr("id", "n + 1 AS n")}, "2025-01-02 00:00:00")["p"]
    assert [(r.id, r.n, r.updated_at.day) for r in after.collect()] == [("a", 2, 2)]
