from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quireflow.functions import hashing, refs
from quireflow.operators import objects, report
from quireflow.sinks import objects as sinks
from quireflow.specs import Storage


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_filter_force_and_disappeared(spark):
    uploads = spark.createDataFrame([("h1", "kv://ns/a"), ("h2", "kv://ns/b")], "hash string, uri string")
    stored = spark.createDataFrame([("h1", "kv://ns/a"), ("h0", "kv://ns/b"), ("h9", "kv://ns/z")], "hash string, uri string")
    assert [r.uri for r in objects.to_upload(uploads, stored).collect()] == ["kv://ns/b"]
    assert objects.to_upload(uploads, stored, force=True).count() == 2
    flags = {r.hash: r.skipped for r in objects.partition_uploads(uploads, stored).collect()}
    assert flags == {"h1": True, "h2": False}
    assert not any(r.skipped for r in objects.partition_uploads(uploads, stored, force=True).collect())
    # h0 is gone, but its key was written in this run; h9 is really gone.
    assert [r.uri for r in objects.disappeared(stored, uploads, uploads).collect()] == ["kv://ns/z"]


def test_pointers_keys_and_hashes(spark):
    one = spark.range(1)
    cid = refs.compound_id(F.lit("post"), F.lit(7))
    for storage, uri, moved in (
        (Storage("r2", bucket="b", prefix="p/q"), "r2://b/p/q/post/7", "r2bp/q/post/7"),
        (Storage("kv", namespace="n"), "kv://n/post/7", "kvnpost/7"),
        (Storage("asset", dir="out"), "asset://out/post/7", "assetout/post/7"),
        (Storage("inline"), "inline://...", "inline"),
    ):
        where = refs.pointer(storage, cid, F.lit("hé"))
        row = one.select(
            refs.object_ref(F.lit("hé"), F.lit("text/plain"), where).alias("o"),
            refs.pointer_uri(where).alias("u"),
        ).collect()[0]
        assert row.u == uri
        assert row.o.hash == sha(sha("hé") + moved)
        assert row.o.size == 3 and row.o.meta is None
    with pytest.raises(ValueError, match="carries the content"):
        refs.pointer(Storage("inline"), cid)


def test_ids_and_base64(spark):
    df = spark.createDataFrame([("././a/",), ("/a//",), (".//x",), ("a b",)], "p string")
    assert [r[0] for r in df.select(refs.id_from_path(F.col("p"))).collect()] == ["./a", "a/", "x", "a b"]
    url = spark.range(1).select(refs.id_from_url(F.lit("a b*~é/+"))).collect()[0][0]
    assert url == "a%20b%2A~%C3%A9%2F%2B"
    text = spark.range(1).select(refs.base64_text(F.repeat(F.lit("x"), 200).cast("binary"))).collect()[0][0]
    assert len(text) == 268


def test_row_hash_sorts_digests(spark):
    from quireflow import CollectionSpec, Field

    spec = CollectionSpec(name="c", table="t", schema=(("id", Field("id")), ("made", Field("created_at")), ("v", Field("string")))).tables()["t"]
    row = spark.range(1).select(
        hashing.row_hash(spec, F.lit("d"), F.array(F.lit("b"), F.lit("a"))).alias("x"),
        hashing.row_hash(spec, F.lit("d"), F.array(F.lit("a"), F.lit("b"))).alias("y"),
    ).collect()[0]
    assert row.x == row.y == sha("d\nid\nv\na\nb")


def test_inventory_without_object_columns_is_empty(spark):
    from quireflow import CollectionSpec, Field

    specs = CollectionSpec(name="c", table="t", schema=(("id", Field("id")),)).tables()
    found = objects.inventory(spark, {"t": spark.createDataFrame([("a",)], "id string")}, specs)
    assert found.count() == 0 and found.columns == ["seq", "hash", "pointer"]


def test_overlay_delete_and_routing(spark, tmp_path):
    stored = spark.createDataFrame([("r2", "a", "1"), ("kv", "b", "1")], "store string, uri string, hash string")
    puts = spark.createDataFrame([("r2", "a", "2"), ("kv", "c", "1")], "store string, uri string, hash string")
    after = objects.overlay(stored, puts, ["store", "uri"])
    assert sorted(tuple(r) for r in after.collect()) == [("kv", "b", "1"), ("kv", "c", "1"), ("r2", "a", "2")]
    left = objects.delete(after, stored, ["store", "uri"])
    assert [r.uri for r in left.collect()] == ["c"]
    mixed = spark.createDataFrame([("r2", "a"), ("inline", "b"), ("kv", "c")], "type string, uri string")
    sinks.write_stores(mixed, str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in written.select("store", "uri").collect()) == [("kv", "c"), ("r2", "a")]
    seen = {}
    sinks.dispatch(mixed, {"kv": lambda df: seen.update(kv=df.collect()), "asset": lambda df: seen.update(asset=df.collect())})
    assert [r.uri for r in seen["kv"]] == ["c"] and seen["asset"] == []
    with pytest.raises(ValueError, match="no such stores"):
        sinks.dispatch(mixed, {"ftp": print})
    folder = str(tmp_path)

    def put(rows):
        for row in rows:
            with open(f"{folder}/put-{row.uri}", "w") as out:
                out.write(row.uri)

    sinks.dispatch(mixed, {"kv": sinks.per_partition(put), "r2": sinks.per_partition(put)})
    assert sorted(p.name for p in tmp_path.glob("put-*")) == ["put-a", "put-c"]


def test_reports(spark):
    entries = spark.createDataFrame([("b", "done"), ("a", "failed")], "entry string, status string")
    uploads = spark.createDataFrame([("b", "u1", "uploaded"), ("b", "u2", "skipped"), ("b", "u3", "lost")], "entry string, uri string, status string")
    warnings = spark.createDataFrame([("a", "odd")], "entry string, message string")
    assert tuple(report.run_report(entries, uploads).collect()[0]) == (2, 1, 1, 2)
    assert [tuple(r) for r in report.entry_report(entries, uploads, warnings).collect()] == [
        ("a", "failed", 1, 0, 0),
        ("b", "done", 0, 1, 1),
    ]
    lines = [(r.entry, r.line) for r in report.report_lines(entries, uploads, warnings).collect()]
    assert lines[:3] == [("a", "failed"), ("a", "odd"), ("b", "done")] and len(lines) == 6
