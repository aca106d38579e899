from __future__ import annotations

import random

import pytest

from quireflow import CollectionSpec, Field
from quireflow.operators import checks, dedup, diff, joins
from quireflow.plans import sync
from quireflow.plans.apply import run_batch
from quireflow.sinks.snapshots import SnapshotStore

T0, T1 = "2020-01-01 00:00:00", "2025-01-01 00:00:00"

SPECS = CollectionSpec(
    name="c",
    table="p",
    schema=(
        ("id", Field("id")),
        ("v", Field("string")),
        ("made", Field("created_at")),
        ("moved", Field("updated_at")),
        (
            "kids",
            Field(
                "records",
                table="k",
                inherit_ids=("pid",),
                schema=(
                    ("kid", Field("id")),
                    ("v", Field("string")),
                    ("made", Field("created_at")),
                    ("moved", Field("updated_at")),
                    ("tags", Field("records", table="t", inherit_ids=("pid", "kid"), schema=(("tag", Field("id")),))),
                ),
            ),
        ),
    ),
).tables()


def frame(spark, name, rows, stamp=None):
    spec = SPECS[name]
    cols = [*spec.pk, *spec.data_cols]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    for c in (spec.created_at, spec.updated_at):
        if stamp and c:
            df = df.withColumn(c, diff.run_timestamp(stamp))
    return df


def got(df, *cols):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in df.select(*cols).collect())


def test_feed_is_null_safe(spark):
    old = frame(spark, "p", [("a", None), ("b", "1"), ("c", None), ("d", "x"), ("gone", "x")])
    new = frame(spark, "p", [("a", None), ("b", None), ("c", "1"), ("d", "x"), ("new", None)])
    assert got(diff.change_feed(old, new, SPECS["p"]), "id", "op") == [
        ("a", "unchanged"),
        ("b", "update"),
        ("c", "update"),
        ("d", "unchanged"),
        ("gone", "delete"),
        ("new", "insert"),
    ]


def test_anti_join_survives_a_null_key(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a",), (None,)], "k string")
    assert got(joins.anti_by_key(left, right, ["k"]), "k") == [("b",)]


def test_last_wins_does_not_depend_on_row_order(spark):
    rows = [("a", i, str(i)) for i in range(50)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, seq int, v string").repartition(4)
    assert got(dedup.last_wins(df, ["k"], ["seq"]), "k", "seq", "v") == [("a", "49", "49")]


def brute_force(old, new):
    """The run, row by row, on dicts of {name: {key: value}}; returns states with stamps."""
    dirty = {n: {k for k in old[n].keys() | new[n].keys() if old[n].get(k, 0) != new[n].get(k, 0)} for n in old}
    touched = {
        "p": {k[:1] for n in ("k", "t") for k in dirty[n]},
        "k": {k[:2] for k in dirty["t"]},
        "t": set(),
    }
    out = {}
    for n in old:
        for k, v in new[n].items():
            made = T0 if k in old[n] else T1
            moved = T1 if k in dirty[n] or k in touched[n] else T0
            out.setdefault(n, []).append((*k, *([v or "", made, moved] if n != "t" else [])))
    return {n: sorted(rows) for n, rows in out.items()}


def random_tree(rng):
    tree = {"p": {}, "k": {}, "t": {}}
    for p in range(12):
        if rng.random() < 0.3:
            continue
        tree["p"][(f"p{p}",)] = rng.choice(["x", "y", None])
        for k in range(3):
            if rng.random() < 0.4:
                continue
            tree["k"][(f"p{p}", f"k{k}")] = rng.choice(["x", "y", None])
            for t in range(2):
                if rng.random() < 0.5:
                    tree["t"][(f"p{p}", f"k{k}", f"t{t}")] = ""
    return tree


@pytest.mark.parametrize("seed", [1, 2])
def test_sync_equals_row_by_row(spark, seed):
    rng = random.Random(seed)
    old, new = random_tree(rng), random_tree(rng)

    def frames(tree, stamp):
        return {
            n: frame(spark, n, [(*k, v)[: len(SPECS[n].pk) + len(SPECS[n].data_cols)] for k, v in rows.items()], stamp)
            for n, rows in tree.items()
        }

    old_df, new_df = frames(old, T0), frames(new, None)
    state = sync.sync_tables(old_df, new_df, SPECS, T1)
    want = brute_force(old, new)
    for n, spec in SPECS.items():
        stamps = [] if n == "t" else ["made", "moved"]
        assert got(state[n], *spec.pk, *spec.data_cols, *stamps) == want.get(n, []), n
        split = diff.cleanup(diff.upsert(old_df[n], new_df[n], spec, T1), new_df[n], spec)
        assert got(split, *spec.pk, *spec.data_cols) == got(state[n], *spec.pk, *spec.data_cols)
    ops = got(sync.sync_changes(old_df, new_df, SPECS), "table_name", "key", "op")
    for name, key, op in ops:
        k = tuple(key.split("/"))
        here, there = k in old[name], k in new[name]
        assert op == {(False, True): "insert", (True, False): "delete"}.get(
            (here, there), "update" if old[name].get(k) != new[name].get(k) else "touch"
        )
    touched = {k for n, k, op in ops if op == "touch"}
    same = [r for r in want["p"] if r[2] == T0 and r[3] == T1 and old["p"][r[:1]] == new["p"][r[:1]]]
    assert {r[0] for r in same} <= touched


def test_a_second_run_changes_nothing_and_a_missing_table_empties(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    new = {
        "p": frame(spark, "p", [("a", "1"), ("b", None)]),
        "k": frame(spark, "k", [("a", "k1", "1")]),
        "t": frame(spark, "t", [("a", "k1", "t1")]),
    }
    first, _ = run_batch(store, SPECS, new, T0)
    second, _ = run_batch(store, SPECS, new, T1)
    for n in SPECS:
        assert got(first[n], *first[n].columns) == got(second[n], *first[n].columns)
    assert store.versions("p") == [1] and store.at().version == 1
    third, _ = run_batch(store, SPECS, {"p": new["p"], "k": new["k"]}, T1)
    assert third["t"].count() == 0
    assert got(third["k"], "kid", "moved") == [("k1", T1)]


def test_cascade_drops_descendants(spark):
    tables = {
        "p": frame(spark, "p", [("a", "1")]),
        "k": frame(spark, "k", [("a", "k1", "1"), ("b", "k1", "1")]),
        "t": frame(spark, "t", [("a", "k1", "t"), ("b", "k1", "t"), ("a", "k9", "t")]),
    }
    left = diff.cascade(tables, SPECS)
    assert got(left["k"], "pid", "kid") == [("a", "k1")]
    assert got(left["t"], "pid", "kid", "tag") == [("a", "k1", "t")]


def test_prefix_semi_and_checks(spark):
    p = frame(spark, "p", [("a", "1"), ("b", "2")])
    t = frame(spark, "t", [("b", "k", "t"), ("b", "k", "t"), ("z", "k", "t")])
    assert got(diff.key_prefix_semi(p, SPECS["p"], t, SPECS["t"]), "id") == [("b",)]
    assert got(checks.duplicate_keys(t, SPECS["t"].pk), "pid", "n_rows") == [("b", "2")]
    assert got(checks.orphan_keys(t, p, ["pid"], ["id"]), "pid", "n_rows") == [("z", "1")]
    report = checks.contract(p.withColumn("made", p["v"]), [("id", "not_null"), ("made", "iso_datetime")])
    assert got(report, "column_name", "violations") == [("id", "0"), ("made", "2")]
    assert ("made", "iso_datetime") in checks.rules_for(SPECS["p"])
