"""Licence scans by a positional index of rare words.

The index holds, for each template, its ``rare`` words of highest IDF over all documents, and where in the template they stand.
Each place in a file where such a word occurs proposes where a template would start; places that
propose the same start agree by relative position. A start counts if the words found there carry enough of the template's IDF and if
the template's mandatory key phrase stands word for word at its place. A text may begin inside a template, so a start may lie before
its first word; the words it lacks count as missing. Base phrases are templates whose key
phrase is all of them, so all their places are found. DataFrame functions only; the only shuffle counts words of the templates.

Defined cases: null and empty texts have no words, no labels and score 0; rows with the same id are scanned one
by one; a template word that occurs nowhere has the highest IDF, and its template cannot match by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels; fixed values.
BASE = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}
# Well-known sentences of public licences with the phrase that must be there; fixed values.
TEMPLATES = {
    "agpl": ("gnu affero general public license", "affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-nd": ("licensed under cc by nd 4 0", "cc by nd"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa"),
    "cc0": ("to the public domain worldwide under cc0 1 0", "cc0 1 0"),
    "gpl-2": ("licensed under the gnu general public license version 2", "general public license version 2"),
    "gpl-3": ("licensed under the gnu general public license version 3", "general public license version 3"),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "with or without fee is hereby granted",
    ),
    "lgpl": ("gnu lesser general public license", "lesser general public license"),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files",
        "permission is hereby granted free of charge",
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla public license v 2 0",
    ),
    "unlicense": ("this is free and unencumbered software released into the public domain", "free and unencumbered software"),
}


@dataclass
class Template:
    label: str
    words: list[str]
    key: list[str]
    key_at: int
    share: float  # least share of the rare words' IDF that must stand in place


def default_templates(share: float = 0.5) -> list[Template]:
    out = [Template(label, p.split(), p.split(), 0, 0.0) for label, p in BASE.items()]
    for label, (text, key) in TEMPLATES.items():
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        out.append(Template(label, words, phrase, at, share))
    return out


def words_column(text: str = "text") -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def idf_of(words: DataFrame, templates: list[Template]) -> dict[str, float]:
    """IDF of every template word over all rows of ``words`` (column words)."""
    wanted = sorted({w for t in templates for w in t.words})
    seen = words.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(wanted)))).alias("w"))
    counts = {r.w: r["count"] for r in seen.groupBy("w").count().collect()}
    n = max(words.count(), 1)
    return {w: math.log(1 + n / (1 + counts.get(w, 0))) for w in wanted}


def _index(templates: list[Template], idf: dict[str, float], rare: int) -> list[list[tuple[int, str, float]]]:
    """Of each template, places and weights of its rarest words; key words alone for base phrases."""
    out = []
    for t in templates:
        order = sorted(range(len(t.words)), key=lambda i: (-idf[t.words[i]], i))
        # A word of the key phrase is always among them, so that every place of the phrase is proposed.
        anchor = min(range(t.key_at, t.key_at + len(t.key)), key=lambda i: (-idf[t.words[i]], i))
        chosen = sorted({anchor, *order[: rare if t.share else 1]})
        out.append([(i, t.words[i], idf[t.words[i]]) for i in chosen])
    return out


def license_scan(docs: DataFrame, templates: list[Template] | None = None, rare: int = 6) -> DataFrame:
    """doc_id, n_words and ``found`` of each row: (start, template number, share), all places of all templates."""
    templates = templates or default_templates()
    width = len(templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_column().alias("words"))
    idf = idf_of(rows, templates)
    index = _index(templates, idf, rare)
    # A posting is template - place * width, so that word place * width + posting is start * width + template.
    postings: dict[str, list[int]] = {}
    for t, chosen in enumerate(index):
        for place, word, _ in chosen:
            postings.setdefault(word, []).append(t - place * width)
    table = F.create_map(*[x for w, ps in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.lit(p).cast("long") for p in ps]))])
    about = F.array(
        *[
            F.struct(
                F.array(*map(F.lit, t.key)).alias("key"),
                F.lit(t.key_at).alias("key_at"),
                F.lit(t.share).alias("least"),
                F.array(*[F.struct(F.lit(i).alias("place"), F.lit(w).alias("word"), F.lit(v).alias("weight")) for i, w, v in chosen]).alias("rare"),
                F.lit(sum(v for _, _, v in chosen)).alias("total"),
            )
            for t, chosen in zip(templates, index)
        ]
    )
    hits = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(sorted(postings)), F.struct(w.alias("w"), i.cast("long").alias("i")))), F.isnotnull
    )
    proposed = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(table[h["w"]], lambda p: h["i"] * width + p))))

    def weigh(start: Column, t: Column) -> Column:
        def add(sum_: Column, r: Column) -> Column:
            at = start + r["place"] + 1  # words before the text's first are missing
            there = F.try_element_at("words", F.greatest(at, F.lit(1)).cast("int")) == r["word"]
            return sum_ + F.when((at > 0) & there, r["weight"]).otherwise(0.0)

        return F.aggregate(t["rare"], F.lit(0.0), add) / t["total"]

    def judge(code: Column) -> Column:
        start, number = F.floor(code / width), F.pmod(code, F.lit(width)).cast("int")
        t = about[number]
        at = start + t["key_at"] + 1
        whole = F.slice("words", F.greatest(at, F.lit(1)).cast("int"), F.size(t["key"])) == t["key"]
        return F.when((at > 0) & whole, F.struct(start.alias("start"), number.alias("template"), weigh(start, t).alias("share"), t["least"].alias("least")))

    judged = F.filter(F.transform("proposed", judge), lambda x: x.isNotNull() & (x["share"] >= x["least"]))
    found = F.array_sort(F.transform(judged, lambda x: F.struct(x["start"].alias("start"), x["template"].alias("template"), x["share"].alias("share"))))
    return (
        rows.withColumn("hits", hits)
        .withColumn("proposed", proposed)
        .select("doc_id", F.size("words").cast("long").alias("n_words"), found.alias("found"))
    )


def report(scans: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """Counts, places and labels of the scan, one row per document."""
    templates = templates or default_templates()
    n_base = len(BASE)
    names = F.array(*[F.lit(t.label) for t in templates])
    base = F.filter("found", lambda x: x["template"] < n_base)
    starts = F.transform("base", lambda x: x["start"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: names[x["template"]]))), ",")
    return scans.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("found").alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )
