"""Documents on disk to tables and back into a store, over several runs."""

from __future__ import annotations

import struct
import zlib

import pytest
import yaml
from pyspark.sql import functions as F

from quireflow import CollectionSpec
from quireflow.operators import markup
from quireflow.plans.apply import run_batch
from quireflow.plans.compile import compile_documents, compile_records, records_of, with_payload
from quireflow.sinks.snapshots import SnapshotStore
from quireflow.sources import attachments
from quireflow.specs import Storage
from quireflow.streaming import incremental

T1, T2 = "2025-01-01 00:00:00", "2025-02-02 00:00:00"


def table_of(name, fields, **rest):
    return {"name": name, "table": name, "database_id": "depot", "glob": "**/*", "syntax": {"type": "toml"}, "schema": fields} | rest


def below(name, parents, fields):
    return {"type": "records", "table": name, "inherit_ids": parents, "schema": fields}


ID, TEXT = {"type": "id"}, {"type": "string"}
STAMPS = {"seen_at": {"type": "created_at"}, "changed_at": {"type": "updated_at"}}

#: A workshop: tools with bare keywords.
TOOLS = table_of("tools", {"code": ID, "keywords": below("keywords", ["tool"], {"word": ID})})

#: Orders, their lines, and notes on a line.
ORDERS = table_of(
    "orders",
    {
        "number": ID, "buyer": TEXT, **STAMPS,
        "lines": below("lines", ["order_number"], {
            "sku": ID, "pieces": {"type": "integer"}, **STAMPS,
            "notes": below("notes", ["order_number", "line_sku"], {"stamp": ID, "wording": TEXT, **STAMPS}),
        }),
    },
)

#: Deliveries with scanned slips.
DELIVERIES = table_of(
    "deliveries",
    {
        "lorry": ID, **STAMPS,
        "slips": below("slips", ["lorry"], {
            "page": ID, **STAMPS, "scan": {"type": "file", "required": True, "storage": {"type": "r2", "bucket": "paper", "prefix": "slips"}},
        }),
    },
)

#: Field guides in Markdown: a plate, a text with drawings, sightings with a text of their own.
GUIDES = table_of(
    "guides",
    {
        "species": ID, "fingerprint": {"type": "hash"}, "plate": {"type": "image", "storage": {"type": "r2", "bucket": "art", "prefix": "plates"}},
        "checked": {"type": "boolean"}, "printed": {"type": "datetime", "required": True},
        "description": {
            "type": "markdown", "config": {}, "storage": {"type": "kv", "namespace": "texts"},
            "image": {"table": "drawings", "inherit_ids": ["species"], "embed_svg_threshold": 40, "storage": {"type": "r2", "bucket": "art", "prefix": "drawings"}},
        },
        "sightings": below("sightings", ["species"], {
            "day": ID,
            "remark": {
                "type": "markdown", "config": {}, "storage": {"type": "inline"},
                "image": {"table": "snapshots", "inherit_ids": ["species", "day"], "embed_svg_threshold": 40, "storage": {"type": "r2", "bucket": "art"}},
            },
        }),
        "regions": below("regions", ["species"], {"region": ID}),
    },
    syntax={"type": "markdown", "column": "description"},
)


def collection(config: dict) -> CollectionSpec:
    return CollectionSpec.from_config(config, yaml.safe_dump(config))


def write(folder, files: dict[str, str | bytes]) -> str:
    for name, body in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(folder)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def png(width: int, height: int) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    line = b"\x00" + b"\xff\x00\x00" * width
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", header)
        + chunk(b"IDAT", zlib.compress(line * height))
        + chunk(b"IEND", b"")
    )


def test_bare_children_follow_the_document(spark, tmp_path):
    spec = collection(TOOLS)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    for stamp, words in ((T1, ["steel", "heavy", "old"]), (T2, ["heavy", "sharp"])):
        folder = write(tmp_path / stamp[:4] / stamp[5:7], {"axe.toml": f'code = "axe"\nkeywords = {words}\n'})
        tables, _ = run_batch(store, spec.tables(), compile_documents(spark, spec, folder, "*.toml").tables, stamp)
        assert rows(tables["keywords"], "tool", "word") == [("axe", w) for w in sorted(words)]
    assert rows(tables["tools"], "code") == [("axe",)]


def test_a_note_moves_its_line_and_order_only(spark, tmp_path):
    spec = collection(ORDERS)
    store = SnapshotStore(spark, str(tmp_path / "store"))

    def order(number: str, wording: str) -> str:
        return (
            f'number = "{number}"\nbuyer = "b{number}"\n[[lines]]\nsku = "nail"\npieces = 40\n'
            f'[[lines.notes]]\nstamp = "n1"\nwording = "{wording}"\n[[lines]]\nsku = "screw"\npieces = 7\n'
        )

    def run(k: int, wording: str, stamp: str) -> dict:
        folder = write(tmp_path / f"day{k}", {"one.toml": order("1", wording), "two.toml": order("2", "as ever")})
        tables, _ = run_batch(store, spec.tables(), compile_documents(spark, spec, folder, "*.toml").tables, stamp)
        assert {str(r.seen_at) for t in tables.values() for r in t.collect()} == {T1}
        return {n: rows(t.where(F.col("changed_at") == F.lit(T2).cast("timestamp")), *spec.tables()[n].pk) for n, t in tables.items()}

    nothing = {"orders": [], "lines": [], "notes": []}
    assert run(0, "urgent", T1) == nothing and run(1, "urgent", T2) == nothing
    assert run(2, "can wait", T2) == {"orders": [("1",)], "lines": [("1", "nail")], "notes": [("1", "nail", "n1")]}


def slip(lorry: str, **scans: str) -> str:
    pages = "".join(f'[[slips]]\npage = "{p}"\nscan = "{f}"\n' for p, f in scans.items())
    return f'lorry = "{lorry}"\n{pages}'


def test_objects_are_uploaded_skipped_and_deleted(spark, tmp_path):
    spec = collection(DELIVERIES)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    paper = {"in/red.txt": "red slip", "in/green.txt": "green slip", "in/blue.txt": "blue slip!"}

    def run(name: str, documents: dict[str, str], stamp: str, **how):
        folder = write(tmp_path / name, paper | documents)
        done = compile_documents(spark, spec, folder, "*.toml")
        tables, actions = run_batch(store, spec.tables(), done.tables, stamp, **how)
        return tables, rows(actions, "action", "uri"), done, folder

    uri = "r2://paper/slips/"
    first = {"x.toml": slip("x", p1="in/red.txt", p2="in/green.txt"), "y.toml": slip("y", p1="in/blue.txt")}
    tables, actions, done, folder = run("first", first, T1)
    assert actions == [("upload", uri + k) for k in ("x/p1", "x/p2", "y/p1")]
    found = rows(tables["slips"], "lorry", "page", "scan.size", "scan.content_type", "scan.pointer.key")
    assert found == [("x", "p1", 8, "text/plain", "slips/x/p1"), ("x", "p2", 10, "text/plain", "slips/x/p2"), ("y", "p1", 10, "text/plain", "slips/y/p1")]
    payload = with_payload(done.uploads, attachments.scan(spark, folder))
    assert {r.source_entry.rsplit("/", 1)[1] for r in done.uploads.collect()} == {"x.toml", "y.toml"}
    assert rows(payload, "body") == [(b"blue slip!",), (b"green slip",), (b"red slip",)]

    # One key gets another content, one stays, and a document is gone with its object.
    second = {"x.toml": slip("x", p1="in/blue.txt", p2="in/green.txt")}
    tables, actions, _, _ = run("second", second, T2)
    assert actions == [("delete", uri + "y/p1"), ("skip", uri + "x/p2"), ("upload", uri + "x/p1")]
    assert rows(tables["deliveries"], "lorry") == [("x",)] and str(tables["deliveries"].first().changed_at) == T2
    assert [str(r.changed_at) for r in tables["slips"].orderBy("page").collect()] == [T2, T1]

    # A full refresh uploads and stamps everything anew.
    tables, actions, _, _ = run("third", second, "2025-03-03 00:00:00", force=True)
    assert {a for a, _ in actions} == {"upload"} and {str(r.seen_at) for r in tables["slips"].collect()} == {"2025-03-03 00:00:00"}


def guide(species: str, text: str = "", **front) -> str:
    return "---\n" + yaml.safe_dump({"species": species, "printed": "2024-05-06T07:08:09"} | front) + f"---\n{text}\n"


def test_markdown_collection(spark, tmp_path):
    spec = collection(GUIDES)
    text = '# Wren\n\n![Egg](egg.png "an egg") and ![Leaf](leaf.svg)\n\n## Song\n\nLoud[^song].\n\n[^song]: In spring.\n'
    folder = write(
        tmp_path / "guides",
        {
            "wren.md": guide("wren", text, plate="plates/wren.png", regions=["moor", "dale"], sightings=[{"day": "monday", "remark": "> [!NOTE]\n> Two of them"}]),
            "kite.md": "---\nspecies: kite\n---\nnever printed\n",
            "open.md": "---\nspecies: open\n",
            "plates/wren.png": png(9, 4), "egg.png": png(3, 2), "leaf.svg": "<svg/>",
        },
    )
    done = compile_documents(spark, spec, folder, "*.md")
    assert list(done.tables) == ["guides", "drawings", "sightings", "snapshots", "regions"]
    (row,) = done.tables["guides"].collect()
    assert (row.species, str(row.printed), row.checked, len(row.fingerprint)) == ("wren", "2024-05-06 07:08:09", None, 64)
    assert (row.plate.meta.width, row.plate.meta.height, row.plate.meta.derived_id) == (9, 4, "plates/wren.png")
    assert (row.description.pointer.type, row.description.pointer.key) == ("kv", "wren")
    # The small vector image stays in the page.
    assert rows(done.tables["drawings"], "species", "src_id", "image.pointer.key") == [("wren", "egg.png", "drawings/wren/egg.png")]
    (remark,) = done.tables["sightings"].collect()
    assert remark.remark.pointer.type == "inline" and "[!NOTE]" in remark.remark.pointer.content
    assert rows(done.tables["regions"], "species", "region") == [("wren", "dale"), ("wren", "moor")]
    letters = {(r.source_entry.rsplit("/", 1)[1], r.field, r.code) for r in done.dead_letters.collect()}
    assert letters == {("kite.md", "printed", "MissingField"), ("open.md", "", "UnclosedFrontmatter")}
    (stored,) = [r.payload_text for r in done.uploads.where("table_name = 'guides' AND payload_text is not null").collect()]
    # Children are there as their rows, with all keys and with what they refer to.
    assert '"regions":[{"species":"wren","region":"moor"},{"species":"wren","region":"dale"}]' in stored
    assert '"sightings":[{"species":"wren","day":"monday","remark":{"hash":' in stored and '"title":"Song"' in stored and '"content":"In spring."' in stored
    with pytest.raises(Exception, match="bad document"):
        compile_documents(spark, spec, folder, "*.md", mode="failfast")

    # The text is the same; a drawing in it is not.
    write(tmp_path / "guides", {"egg.png": png(3, 3)})
    drawn = compile_documents(spark, spec, folder, "*.md").tables["guides"].first()
    assert drawn.fingerprint != row.fingerprint


def test_documents_with_lost_files_are_rejected(spark, tmp_path):
    spec = collection(GUIDES)
    folder = write(
        tmp_path / "guides",
        {
            "a.md": guide("a", "![i](here.png)", sightings=[{"day": "d", "remark": "![x](gone.png)"}], regions=["r"]),
            "b.md": guide("b", "![n](none.png) ![n](none.png) ![r](https://h.example/r.png)"),
            "c.md": guide("c", plate="lost.png"), "d.md": guide("d", "![i](here.png)", plate="here.png"), "e.md": guide("e", plate="data:image/png;base64,@@@"),
            "here.png": png(7, 5),
        },
    )
    done = compile_documents(spark, spec, folder, "*.md")
    assert {n: rows(t, *spec.tables()[n].pk) for n, t in done.tables.items()} == {
        "guides": [("d",)], "drawings": [("d", "here.png")], "sightings": [], "snapshots": [], "regions": [],
    }
    assert {r.pointer.key for r in done.uploads.collect()} == {"plates/d", "d", "drawings/d/here.png"}
    letters = sorted((r.source_entry.rsplit("/", 1)[1], r.id, r.field, r.code, r.got) for r in done.dead_letters.collect())
    assert letters == [
        ("a.md", "a/d", "remark", "LoadFailed", "gone.png"),
        ("b.md", "b", "description", "LoadFailed", "https://h.example/r.png"),
        ("b.md", "b", "description", "LoadFailed", "none.png"),
        ("c.md", "c", "plate", "LoadFailed", "lost.png"),
        ("e.md", "e", "plate", "LoadFailed", "data:image/png;base64,@@@"),
    ]
    # Strict runs fail when a table is computed, whichever it is.
    strict = compile_documents(spark, spec, folder, "*.md", mode="failfast")
    for name in ("guides", "regions"):
        with pytest.raises(Exception, match="LoadFailed"):
            strict.tables[name].collect()


def test_a_required_file_that_is_lost_rejects_the_document(spark, tmp_path):
    spec = collection(DELIVERIES)
    folder = write(tmp_path, {"x.toml": slip("x", p1="in/none.txt"), "y.toml": slip("y", p1="in/y.txt"), "in/y.txt": "y"})
    done = compile_documents(spark, spec, folder, "*.toml")
    assert rows(done.tables["deliveries"], "lorry") == [("y",)] and rows(done.tables["slips"], "lorry") == [("y",)]
    assert rows(done.dead_letters, "id", "field", "code") == [("x/p1", "scan", "LoadFailed")]


def test_image_table_keeps_images_without_a_body(spark):
    docs = spark.createDataFrame([(1, "![a](./img/1.png) ![b](./img/9.png)"), (2, "![b](./img/9.png)")], "doc_id long, md string")
    bodies = spark.createDataFrame([("./img/1.png", "body", "image/png", 3, 4)], "url string, content string, content_type string, width int, height int")
    out = markup.image_table(docs, ["doc_id"], ["doc_id"], "md", bodies, Storage("r2", bucket="assets", prefix="p"))
    assert sorted((r.doc_id, r.src_id, r.image and r.image.size) for r in out.collect()) == [(1, "img/1.png", 4), (1, "img/9.png", None), (2, "img/9.png", None)]


def test_a_stream_of_documents_uploads_before_it_upserts(spark, tmp_path):
    spec = collection(DELIVERIES)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    inbox, seen = tmp_path / "in", []

    def upload(objects):
        there = store.read("slips")
        seen.append((sorted(r.uri for r in objects.collect()), 0 if there is None else there.count()))

    def arrive(**documents: str):
        write(inbox, {f"{name}.toml": body for name, body in documents.items()})
        found = attachments.scan(spark, str(inbox))
        tables = lambda batch: compile_records(spark, spec, records_of(batch, spec), found).tables
        docs = incremental.document_stream(spark, str(inbox), "*.toml")
        incremental.upsert_stream(docs, store, spec.tables(), tables, lambda _: T1, str(tmp_path / "progress"), upload).awaitTermination()

    write(inbox, {"red.txt": "r", "green.txt": "g"})
    arrive(x=slip("x", p="red.txt"))
    arrive(y=slip("y", p="red.txt", q="green.txt"))
    uri = "r2://paper/slips/"
    assert seen == [([uri + "x/p"], 0), ([uri + "y/p", uri + "y/q"], 1)]
    assert rows(store.read("slips"), "lorry", "page") == [("x", "p"), ("y", "p"), ("y", "q")]


def test_payloads_of_data_urls_and_remote_files(spark, tmp_path):
    spec = collection(table_of("cards", {"code": ID, "scan": {"type": "file", "storage": {"type": "r2", "bucket": "scans", "prefix": "c"}}}))
    folder = write(
        tmp_path,
        {
            "one.toml": "code = 'one'\nscan = 'data:text/plain;base64,aGVsbG8='\n",
            "two.toml": "code = 'two'\nscan = 'https://h.example/x.txt'\n",
            "three.toml": "code = 'three'\nscan = './near.txt'\n",
            "near.txt": "near",
        },
    )
    near = attachments.scan(spark, folder)
    far = near.limit(1).withColumn("path", F.lit("https://h.example/x.txt")).withColumn("content", F.lit(b"far"))
    files = near.unionByName(far.withColumn("length", F.lit(3).cast(near.schema["length"].dataType)))
    done = compile_documents(spark, spec, folder, "*.toml", files=files)
    got = {r.pointer.key: bytes(r.body) for r in with_payload(done.uploads, files).collect()}
    assert got == {"c/one": b"hello", "c/two": b"far", "c/three": b"near"}
