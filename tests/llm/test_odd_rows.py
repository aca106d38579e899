"""Every operator and stage on documents over nulls, ties, repeats, large ids, clashing columns and empty tables."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quireflow.llm import context_mixing, language_id, license_scan, near_duplicates, packing, pii, quality_rules, secret_scan, source_mix, weak_labels

BIG = 2**53 + 1
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __n int, __id long, __row string, `a``b` int, s struct<`f-g`:int>, spans string"


@pytest.fixture(scope="module")
def table(spark):
    def of(rows):
        full = [(d, t, None, s, None if t is None else len(t), 1, 2, "r", 3, (4,), "z") for d, t, s in rows]
        return spark.createDataFrame(full, COLUMNS)

    return of


@pytest.fixture(scope="module")
def rows():
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (None, "alpha beta gamma delta epsilon", "b"), (None, None, None), (BIG, "big id one here now", "b"),
        (BIG + 2, "big id two here now", "b"), (4, "same words here again and more", "a"), (4, "same words here again and more", "a"), (4, "other words of the id", "a"),
        (5, "same words here again and more", "c"), (6, "word " * 30_000, "c"), (7, "x" * 5000, None), (8, "a b", "b"),
    ]


OPERATORS = {
    "quality": lambda t: quality_rules.quality_rules(t, t.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))),
    "mixing": context_mixing.score_texts,
    "licence": lambda t: license_scan.report(license_scan.license_scan(t)),
    "near": lambda t: near_duplicates.near_duplicates(t),
    "packing": lambda t: packing.pack_documents(t).where("piece = 0"),
    "mix": source_mix.mix,
    "secrets": lambda t: secret_scan.digest(secret_scan.secret_scan(t)),
    "weak": weak_labels.quality_classifier,
    "language": language_id.language_id,
    "personal": lambda t: pii.report(pii.pii_scan(t)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(table, rows, name):
    out = OPERATORS[name](table(rows)).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(d for d, *_ in rows)
    assert OPERATORS[name](table([])).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, table, rows, name):
    docs, stage = table(rows), dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "")
    assert stage(spark, table([]), "").count() == 0
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    if name == "packing":
        assert ids == {d for d, *_ in rows}
        return
    assert out.columns == docs.columns and out.schema["s"].dataType == docs.schema["s"].dataType
    assert ids <= {d for d, *_ in rows}
    kept = out.where(f"doc_id = {BIG}").collect()
    assert not kept or (kept[0].s["f-g"], kept[0]["a`b"], kept[0]["__n"]) == (4, 3, 1)


@pytest.mark.parametrize("texts", [["a b"], [None], ["a", "b c", "d"], ["", "é"]])
def test_mixing_of_tiny_tables(table, texts):
    out = context_mixing.score_texts(table([(k, t, None) for k, t in enumerate(texts)])).collect()
    assert len(out) == len(texts) and all(r.score < 0 for r in out)


def test_mixing_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    # Sums of a text run in its own order; those of the counts are whole numbers.
    sums = [context_mixing.score_texts(docs.repartition(n)).agg(F.sum("score")).first()[0] for n in (2, 7)]
    assert sums[0] == pytest.approx(sums[1], rel=1e-9)


def test_mixture_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken = [sorted(map(repr, source_mix.mixed_documents(t).collect())) for t in (docs.coalesce(1), docs.repartition(9))]
    assert taken[0] == taken[1]
    sizes = {}
    for r in docs.select("source", "text").collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    total = sum(len((r.text or "").encode().split()) for r in source_mix.mixed_documents(docs).select("text").collect())
    assert 1.4 * sum(sizes.values()) < total <= 1.5 * sum(sizes.values())
