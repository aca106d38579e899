from __future__ import annotations

import hashlib
import json

import check_oracle
import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_compile import png

from quireflow import CollectionSpec, Field
from quireflow.functions import typed
from quireflow.operators import validate
from quireflow.session import work_dir
from quireflow.sinks.snapshots import SnapshotStore
from quireflow.sources import attachments, corpus, decode
from quireflow.sources.tables import spread
from quireflow.streaming import incremental


def test_anchor_and_scan(spark, tmp_path):
    assert corpus.anchored("posts/*.md", "/base") == "/base/posts/*.md"
    assert corpus.anchored("/abs/*.md", "/base") == "/abs/*.md"
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("one\ntwo")
    (tmp_path / "sub/b.md").write_text("three")
    (tmp_path / "c.txt").write_text("no")
    rows = corpus.scan(spark, str(tmp_path), "*.md", "cfg").collect()
    assert sorted(r.text for r in rows) == ["one\ntwo", "three"]


CASES = [
    ("---\nid: a\n---\nbody", ("yaml", "id: a", "body", None)),
    ("+++\nid = 1\n+++\nbody", ("toml", "id = 1", "body", None)),
    ("just text", (None, None, "just text", None)),
    ("lead\n---  \nid: a\n---\nb", ("yaml", "id: a", "b", None)),
    ("---\n---\nbody", ("yaml", None, None, "UnclosedFrontmatter")),
    ("---\nid: a\n", ("yaml", None, None, "UnclosedFrontmatter")),
    ("---\nid: a\n---\nx\n---\ny", ("yaml", "id: a", "x\n---\ny", None)),
    ("+++\na = 1\n---\nb: 1\n---\nrest\n+++\n", ("yaml", "b: 1", "rest\n+++\n", None)),
    ("---\n\nid: a\n---\n\n\nbody", ("yaml", "id: a", "body", None)),
]


def test_frontmatter(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: tuple(r.f) for r in df.select("i", corpus.frontmatter(F.col("t")).alias("f")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_yaml_core_schema_and_toml(spark):
    yaml_text = "a: 2025-09-02\nb: yes\nc: 1:30\nd: 0o14\ne: 014\nf: 1.0\ng: ~\nh: [1, x]\ni: true\nj: 1e3\nk: 0x1F"
    toml_text = 'a = 2025-09-02T10:00:00\nb = 1\nc = 1.0\nd = ["x"]\n[e]\nf = 2024-01-01\n'
    rows = [(0, yaml_text, "yaml"), (1, toml_text, "toml"), (2, "a: [", "yaml"), (3, "- 1", "yaml"), (4, None, None)]
    df = spark.createDataFrame(rows, "i int, t string, s string")
    out = {r.i: r for r in decode.decode(df, ["i"], F.col("t"), F.col("s"), F.lit("B"), "body").drop("record").collect()}
    assert json.loads(out[0].raw) == {
        "a": "2025-09-02", "b": "yes", "c": "1:30", "d": 12, "e": "014", "f": 1.0, "g": None,
        "h": [1, "x"], "i": True, "j": 1000.0, "k": 31, "body": "B",
    }
    assert json.loads(out[1].raw)["e"] == {"f": "2024-01-01"}
    assert out[2].raw is None and out[2].decode_error.startswith("ParseYaml")
    assert out[3].decode_error == "ParseYaml: not a mapping"
    assert json.loads(out[4].raw) == {"body": "B"}


SPEC = CollectionSpec(
    name="c",
    table="t",
    schema=(
        ("id", Field("id")),
        ("h", Field("hash")),
        ("s", Field("string", required=True)),
        ("i", Field("integer")),
        ("r", Field("real")),
        ("d", Field("date")),
        ("m", Field("datetime")),
        ("made", Field("created_at")),
        (
            "kids",
            Field(
                "records",
                table="k",
                inherit_ids=("t",),
                schema=(("kid", Field("id")), ("tags", Field("records", table="g", inherit_ids=("t", "k"), schema=(("g", Field("id")),)))),
            ),
        ),
    ),
)

RECORDS = [
    ('{"id":"a","s":"x","made":5,"other":1}', []),
    ('{"id":"a","s":"x","i":null}', [("a", "i", "TypeMismatch")]),
    ('{"id":"a","s":"x","i":9223372036854775807,"r":1.0}', []),
    ('{"id":"a","s":"x","i":9223372036854775808}', [("a", "i", "TypeMismatch")]),
    ('{"id":"a","s":"x","r":1}', [("a", "r", "TypeMismatch")]),
    ('{"id":"a","s":"x","r":18446744073709551616}', []),
    ('{"id":"a","s":"x","r":1e3}', []),
    ('{"id":"a","s":"x","d":"2024-2-9","m":"2024-02-29T1:2:3.5"}', []),
    ('{"id":"a","s":"x","d":"2023-02-29"}', [("a", "d", "InvalidDate")]),
    ('{"id":"a","s":"x","m":"2024-01-01T00:00:00+01:00"}', [("a", "m", "InvalidDatetime")]),
    ('{"id":"a","s":"x","h":null}', [("a", "h", "FoundComputedField")]),
    ('{"id":7,"i":true}', [("?", "id", "TypeMismatch"), ("?", "s", "MissingField"), ("?", "i", "TypeMismatch")]),
    ('{"id":"a","s":"x","kids":[{"kid":"k","tags":["g",{"g":"h"},3]},5,"bare"]}',
     [("a/k", "tags", "TypeMismatch"), ("a", "kids", "TypeMismatch"), ("a", "kids", "TypeMismatch")]),
    ('{"id":"a","s":"x","kids":{}}', [("a", "kids", "TypeMismatch")]),
    ("[1]", [("?", "", "UnreadableDocument")]),
    ("{broken", [("?", "", "UnreadableDocument")]),
]


def test_validation(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(RECORDS)], "i int, raw string")
    checked = validate.with_errors(df.select("i", typed.parse_record(F.col("raw")).alias("record")), SPEC)
    got = {i: [] for i in range(len(RECORDS))}
    for r in validate.dead_letters(checked, "i").collect():
        got[r.source_entry].append((r.id, r.field, r.code))
    assert got == {i: want for i, (_, want) in enumerate(RECORDS)}
    good = validate.accepted(checked, SPEC)
    assert good.count() == sum(not want for _, want in RECORDS)
    assert sorted(str(r.d) for r in good.where("d is not null").collect()) == ["2024-02-09"]
    with pytest.raises(Exception, match="bad record"):
        validate.accepted(checked, SPEC, mode="failfast").collect()


def test_paths_and_data_urls(spark):
    df = spark.createDataFrame([("/a/b/doc.md", "../x/./y.txt"), ("/a/doc.md", "/r/z"), ("d.md", "q")], "d string, s string")
    assert [r[0] for r in df.select(attachments.beside(F.col("d"), F.col("s"))).collect()] == ["/a/x/y.txt", "/r/z", "q"]
    urls = ["data:text/html;base64,PGI+", "data:,a%20b+c", "data:image/png;base64,@@@", "https://x/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.d for r in df.select(attachments.data_url(F.col("u")).alias("d")).collect()]
    assert (got[0].content_type, bytes(got[0].body)) == ("text/html", b"<b>")
    assert (got[1].content_type, bytes(got[1].body)) == ("text/plain;charset=US-ASCII", b"a b+c")
    assert got[2].error == "DecodeDataUrl" and got[3] is None


def test_image_sizes(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(300, 5))
    (tmp_path / "b.svg").write_text('<?xml version="1.0"?>\n<svg xmlns="x" width="12.5px" height="7" viewBox="0 0 1 1"/>')
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe<svg width='1' height='1'>")
    files = attachments.scan(spark, str(tmp_path))
    rows = files.select("path", attachments.image_size(F.col("content")).alias("i")).collect()
    got = {r.path.rsplit("/", 1)[1]: tuple(r.i) for r in rows}
    assert got == {"a.png": ("png", 300, 5), "b.svg": ("svg", 12, 7), "c.bin": (None, None, None)}
    sizes = attachments.decoded_sizes(spark, str(tmp_path / "a.png")).collect()[0]
    assert (sizes.width, sizes.height) == (300, 5)


def test_spread_only_widens_small_scans(spark):
    wide = spark.range(0, 100, 1, 16)
    assert spread(wide, "id") is wide
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() > 1


def test_spread_follows_the_rows(spark):
    wide = spread(spark.range(0, 1_000_000, 1, 8), "id", task_rows=50_000)
    assert wide.rdd.getNumPartitions() >= 20 and wide.count() == 1_000_000


def test_work_dir_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = work_dir(spark, "x")
    assert folder.startswith(shared.rstrip("/") if shared else "/")
    assert folder != work_dir(spark, "x")


STREAM = CollectionSpec(
    name="s",
    table="t",
    schema=(("id", Field("id")), ("v", Field("string")), ("made", Field("created_at")), ("moved", Field("updated_at"))),
).tables()


def test_stream_upserts_and_replays(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    inbox = tmp_path / "in"
    inbox.mkdir()

    def go(checkpoint: str, stamp: str):
        docs = incremental.document_stream(spark, str(inbox), "*.txt")
        split = lambda b: {"t": b.select(F.split("text", "=")[0].alias("id"), F.split("text", "=")[1].alias("v"))}
        incremental.upsert_stream(docs, store, STREAM, split, lambda _: stamp, str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r.id, r.v, str(r.moved)) for r in store.read("t").collect())

    t1, t2 = "2025-01-01 00:00:00", "2025-02-02 00:00:00"
    (inbox / "a.txt").write_text("a=1")
    (inbox / "b.txt").write_text("b=1")
    assert go("c1", t1) == [("a", "1", t1), ("b", "1", t1)]
    (inbox / "c.txt").write_text("c=9")
    assert go("c1", t2) == [("a", "1", t1), ("b", "1", t1), ("c", "9", t2)]
    # The same files again, as after a lost checkpoint: nothing moves.
    assert go("c2", t2) == [("a", "1", t1), ("b", "1", t1), ("c", "9", t2)]


def test_latest_rows_survive_a_restart_and_late_rows(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=4)
    inbox, schema = tmp_path / "in", "user long, ts long, what string"
    inbox.mkdir()

    def arrive(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        for k, part in enumerate((tmp_path / name).glob("part-*.parquet")):
            (inbox / f"{name}-{k}.parquet").write_bytes(part.read_bytes())

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
        incremental.latest_stream(stream, store, "t", ["user"], ["ts"], str(tmp_path / "progress")).awaitTermination()
        return {r.user: (r.ts, r.what) for r in store.read("t").collect()}

    arrive("a", [(1, 10, "x"), (2, 20, "y"), (1, 11, "z"), (2**53 + 1, 5, "big"), (3, None, "no time")])
    assert go() == {1: (11, "z"), 2: (20, "y"), 2**53 + 1: (5, "big"), 3: (None, "no time")}
    # Late rows lose, ties go by the other columns, null is the least; the query starts again from its checkpoint.
    arrive("b", [(1, 9, "late"), (2, 20, "yy"), (3, 1, "timed"), (4, 7, "new"), (None, 1, "nobody")])
    arrive("c", [(1, 30, "last"), (2, 20, "a"), (4, 6, "late")])
    want = {1: (30, "last"), 2: (20, "yy"), 2**53 + 1: (5, "big"), 3: (1, "timed"), 4: (7, "new"), None: (1, "nobody")}
    assert go() == want
    version = store.at().version
    assert go() == want and store.at().version == version
    # Only keys that changed are in a batch's delta.
    assert [len(b) for b in store.at().tables["t"].deltas.values()][-1] == 1


def test_shards_hold_every_document_whole(spark, tmp_path):
    docs = [(f"in/{k}.{'md' if k % 3 else 'txt'}", f"text {k}\n" * (k + 1)) for k in range(200)] + [("in/long.md", "x" * 300_000)]
    frame = spark.createDataFrame(docs, "source_entry string, text string")
    shards = corpus.pack(frame, str(tmp_path / "s"), shard_bytes=50_000)
    size = sum(len(a) + len(b) for a, b in docs)
    assert shards == -(-size // 50_000) and len(list((tmp_path / "s").glob("part-*"))) <= shards
    found = {r.source_entry: (r.text, r.doc_hash) for r in corpus.scan_shards(spark, str(tmp_path / "s"), "*.md", "c").collect()}
    want = {a: (b, hashlib.sha256(("c" + b).encode()).hexdigest()) for a, b in docs if a.endswith(".md")}
    assert found == want
    assert corpus.scan_shards(spark, str(tmp_path / "s"), "1?.*").count() == 10
    assert corpus.pack(frame.limit(0), str(tmp_path / "none")) == 1 and corpus.scan_shards(spark, str(tmp_path / "none")).count() == 0


def test_decoding_takes_a_batch_in_small_slices(spark):
    """However large a batch is, few of its texts are Python values at a time; rows keep their order, nulls too."""
    kinds = ["yaml", "toml", None]
    texts = [None if k % 50 == 7 else f"id: {k}\ntext: {'é' * 20_000}\n" if k % 3 == 0 else f"id = {k}\ntext = '{'x' * 30_000}'\n" for k in range(300)]
    syntaxes = [kinds[k % 3] for k in range(300)]
    parts = list(decode._decoder("gone")(iter([(pa.array(texts), pa.array(syntaxes)), (pa.array([], pa.string()), pa.array([], pa.string()))])))
    assert len(parts) > 5 and max(p.nbytes for p in parts) < 2 * decode.SLICE_BYTES
    raw = [json.loads(r["raw"]) for p in parts for r in p.to_pylist()]
    want = [{} if t is None or k % 3 == 2 else {"id": k, "text": "é" * 20_000 if k % 3 == 0 else "x" * 30_000} for k, t in enumerate(texts)]
    assert raw == want
    frame = spark.createDataFrame([(k, *row) for k, row in enumerate(zip(texts, syntaxes))], "k int, t string, s string")
    out = decode.decode(frame.repartition(2), ["k"], F.col("t"), F.col("s")).select("k", "raw", "decode_error").collect()
    assert {r.k: json.loads(r.raw) for r in out} == dict(enumerate(want)) and not any(r.decode_error for r in out)


def test_shards_grow_before_they_get_too_many(spark, tmp_path, monkeypatch):
    """A stream's batches do not get as many as the corpus is large; small corpora and the largest shards stay as they were."""
    monkeypatch.setattr(corpus, "SHARD_BYTES", 20_000)
    for n, want in ((5, 2), (40, 4), (400, 20)):
        docs = [(f"f{k:04}", "x" * 995) for k in range(n)]
        folder = str(tmp_path / f"s{n}")
        frame = spark.createDataFrame(docs, "source_entry string, text string")
        assert corpus.pack(frame, folder, 4_000, 4) == want
        assert sorted(map(tuple, spark.read.parquet(folder).collect())) == docs


@pytest.mark.parametrize("name", ["src_image_dims", "src_raster_dims"])
def test_images_wider_than_their_format_can_say(spark, tmp_path, name):
    ids = [*range(12), *range(16_380, 16_395), *range(65_530, 65_545), *range(131_000, 131_040), *range(2**24 - 8, 2**24 + 8), 2**31 - 2]
    spark.createDataFrame([(k, "", f"<p>{k}</p>") for k in ids], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    ok, note = check_oracle.compare(spark, con, str(tmp_path), name)
    assert ok, note


def test_sides_of_a_bitmap(spark):
    def bmp(header: int, sides: bytes) -> bytearray:
        return bytearray(b"BM" + bytes(12) + header.to_bytes(4, "little") + sides + bytes(8))

    wide = (70_000).to_bytes(4, "little")
    cases = [(bmp(40, wide + wide), 70_000, 70_000), (bmp(40, wide + (-70_000).to_bytes(4, "little", signed=True)), 70_000, 70_000), (bmp(12, b"\x05\x01\x07\x00"), 261, 7)]
    rows = spark.createDataFrame([(c[0],) for c in cases], "content binary").select(attachments.image_size(F.col("content")).alias("i"))
    assert [(r.i.format, r.i.width, r.i.height) for r in rows.collect()] == [("bmp", w, h) for _, w, h in cases]


def test_latest_rows_are_settled_without_python(spark, tmp_path):
    """Python state costs a call for each key and batch; the aggregate's state needs no worker."""
    rows = spark.range(3000).selectExpr("id % 700 AS user", "id AS ts", "concat('w', id) AS what")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=4)
    running = incremental.latest_stream(stream, store, "t", ["user"], ["ts"], str(tmp_path / "progress"))
    running.awaitTermination()
    plan = running._jsq.explainInternal(True)
    assert "StateStoreSave" in plan and "Arrow" not in plan and "Python" not in plan
    got = {r.user: (r.ts, r.what) for r in store.read("t").collect()}
    assert got == {u: (t, f"w{t}") for u in range(700) for t in [max(range(u, 3000, 700))]}
