from __future__ import annotations

import pytest
from pyspark.sql import types as T

from quireflow import CollectionSpec, Field, SpecError, Storage


def spec(*fields, **more) -> CollectionSpec:
    return CollectionSpec(name="c", table="posts", schema=tuple(fields), **more)


ID = ("id", Field("id"))
R2 = Storage("r2", bucket="b")


def records(table, inherit, *fields):
    return Field("records", table=table, inherit_ids=inherit, schema=tuple(fields))


def test_tables_come_parent_first_and_depth_first():
    tables = spec(
        ID,
        ("a", records("as", ("post_id",), ("a_id", Field("id")), ("deep", records("deeps", ("p", "a"), ID)))),
        ("b", records("bs", ("post_id",), ID)),
    ).tables()
    assert list(tables) == ["posts", "as", "deeps", "bs"]
    assert tables["deeps"].pk == ["p", "a", "id"]
    assert tables["deeps"].parent_key == ("post_id", "a_id")


def test_key_arity_must_match_the_parent():
    with pytest.raises(SpecError, match="inherits 1"):
        spec(ID, ("a", records("as", ("p",), ID, ("d", records("ds", ("p",), ID))))).tables()


@pytest.mark.parametrize("kind", ["created_at", "updated_at"])
def test_a_table_has_one_stamp_of_a_kind(kind):
    with pytest.raises(SpecError, match=f"{kind} more than once"):
        spec(ID, ("x", Field(kind)), ("y", Field(kind))).tables()


def test_an_id_is_needed_and_the_first_counts_the_last_hash_does():
    with pytest.raises(SpecError, match="declares no id"):
        spec(("x", Field("string"))).tables()
    table = spec(("x", Field("id")), ("y", Field("id")), ("h", Field("hash")), ("g", Field("hash"))).tables()["posts"]
    assert (table.id_name, table.hash_name) == ("x", "g")


def test_columns_data_and_types():
    table = spec(
        ID,
        ("made", Field("created_at")),
        ("n", Field("integer", required=True)),
        ("at", Field("datetime")),
        ("f", Field("file", storage=R2)),
        ("tags", records("tags", ("post_id",), ("tag", Field("id")))),
    ).tables()
    posts = table["posts"]
    assert posts.columns == ["id", "made", "n", "at", "f"]
    assert posts.data_cols == ["n", "at", "f"]
    assert posts.object_cols == ["f"]
    assert [f.nullable for f in posts.struct_type] == [False, False, False, True, True]
    assert posts.struct_type["at"].dataType == T.TimestampNTZType()
    assert table["tags"].id_only and not posts.id_only


def test_storages_need_their_place():
    with pytest.raises(SpecError, match="bucket"):
        Storage("r2")
    with pytest.raises(SpecError, match="unknown storage"):
        Storage("ftp")
    with pytest.raises(SpecError, match="needs a storage"):
        Field("file")
