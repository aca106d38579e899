from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quireflow.functions import html, markup
from quireflow.functions.languages import LANGUAGES, with_language


def run(spark, text, feature):
    out = spark.createDataFrame([(text,)], "t string").select(feature(F.col("t")).alias("f")).collect()[0].f
    return [tuple(r) if hasattr(r, "__fields__") else r for r in out] if isinstance(out, list) else out


FENCES = [
    ("sql", "sql", []),
    ("toml {wrap}", "toml", [("wrap", "true", "boolean")]),
    ("go {width=80, fold=false}", "go", [("width", "80", "integer"), ("fold", "false", "boolean")]),
    ("{caption='A table'}", None, [("caption", "A table", "string")]),
    (r"yaml {note='it\'s'}", "yaml", [("note", "it's", "string")]),
    (r'css {sep="a\tb"}', "css", [("sep", "a\tb", "string")]),
    ("lua {k=1, j=2, k=3}", "lua", [("j", "2", "integer"), ("k", "3", "integer")]),
    ("lua {k=1, never closed", "lua", []),
    ("   ", None, []),
    ("java {" + ", ".join(f"a{i}={i}" for i in range(300)) + "}", "java", [(f"a{i}", str(i), "integer") for i in range(300)]),
]


def test_fence_info(spark):
    df = spark.createDataFrame([(i, info) for i, (info, _, _) in enumerate(FENCES)], "i int, info string")
    rows = df.select("i", markup.fence_lang(F.col("info")).alias("lang"), markup.fence_attributes(F.col("info")).alias("a"))
    got = {r.i: (r.lang, [tuple(x) for x in r.a]) for r in rows.collect()}
    assert got == {i: (lang, attrs) for i, (_, lang, attrs) in enumerate(FENCES)}


def test_languages(spark):
    assert len(LANGUAGES) == 31
    df = spark.createDataFrame([("RS",), ("c++",), ("cobol",), ("",)], "t string")
    got = {r.t: r.language for r in with_language(df, F.col("t")).collect()}
    assert got == {"RS": "rust", "c++": "cpp", "cobol": "plain", "": "plain"}


def test_nothing_inside_a_fence_is_markup(spark):
    text = (
        "# A\n````md {title=\"T\"}\n# no\n```\n[x](y) ![i](j) [^n] $m$\n- [ ] no\n````\n"
        "~~~\nopen | no\n--|--\n~~~~\n## B b {#own}\ntail\n```x\nnot closed\n# no"
    )
    assert [(s[1], s[2], s[3]) for s in run(spark, text, markup.sections)] == [(1, "A", "A"), (2, "own", "B b")]
    codes = run(spark, text, markup.code_blocks)
    assert [(c[1], c[3]) for c in codes] == [('md {title="T"}', 4), ("", 2), ("x", 2)]
    assert codes[0][2] == "# no\n```\n[x](y) ![i](j) [^n] $m$\n- [ ] no\n"
    for feature in (markup.links, markup.images, markup.footnotes, markup.math_spans, markup.tasks, markup.table_cells):
        assert run(spark, text, feature) == []


def test_headings(spark):
    text = "#no\n###### Six ######\r\n####### seven\n#\nText\n    # code"
    got = [(s[1], s[2], s[3], s[4]) for s in run(spark, text, markup.sections)]
    assert got == [(6, "Six", "Six", "####### seven"), (1, "", "", "Text\n    # code")]
    slug = spark.range(1).select(markup.slug(F.lit("Héllo, Wörld-2 x")), markup.heading_id(F.lit("A b\tc"))).collect()[0]
    assert tuple(slug) == ("héllowörld-2x", "A-b-c")


def test_footnote_numbers_leave_gaps(spark):
    text = "a[^x] b[^y] c[^x] d[^z] `[^x]`\n\n[^x]: one\n[^z]: three [^x] [^w]\n[^w]: four"
    got = {(p, i): (n, c) for p, s, i, n, c in run(spark, text, markup.footnotes) if p == "definition"}
    assert got == {
        ("definition", "x"): (1, "one"),
        ("definition", "z"): (3, "three [^x] [^w]"),
        ("definition", "w"): (5, "four"),
    }
    refs = [(i, n) for p, s, i, n, c in run(spark, text, markup.footnotes) if p == "reference"]
    assert refs == [("x", 1), ("y", None), ("x", 1), ("z", 3), ("x", 1), ("w", 5)]


def test_links_alerts_tables_math(spark):
    text = (
        'See [a](b "c"), ![i](k), [[W]], <x@y.org>, <https://q.org/>, [r][ref] [n][none] `[no](x)`\n\n'
        "https://alone.org/x\n\nhttps://not.alone.org text\n\n[ref]: <https://r.org> \"R\"\n"
    )
    assert [(k[1], k[2], k[3], k[4]) for k in run(spark, text, markup.links)] == [
        ("b", "c", "a", "normal"),
        ("W", "", "W", "wikilink"),
        ("x@y.org", "", "x@y.org", "email"),
        ("https://q.org/", "", "https://q.org/", "autolink"),
        ("https://r.org", "R", "r", "normal"),
        ("", "", "n", "broken"),
        ("https://alone.org/x", "https://alone.org/x", "https://alone.org/x", "autolink"),
    ]
    assert run(spark, text, markup.isolated_links) == ["https://alone.org/x"]
    alerts = run(spark, "> [!TIP]\n> a\n> b\n\n> plain\n> [!NOTE]\n\n> [!WARNING]\n", markup.alerts)
    assert [(a[1], a[2]) for a in alerts] == [("tip", "a\nb"), ("warning", "")]
    cells = run(spark, "a | b\n:-:|--\n1 | x\\|y | extra\n2\n\n| no |\n", markup.table_cells)
    assert [(c[1], c[2], c[3], c[4]) for c in cells] == [
        (0, 0, "center", "a"),
        (0, 1, "none", "b"),
        (1, 0, "center", "1"),
        (1, 1, "none", "x\\|y"),
    ]
    spans = run(spark, "cost $5 and $6, $x+1$ and\n$$\na\nb\n$$\n`$no$`", markup.math_spans)
    assert [(s[1], s[2]) for s in spans] == [(False, "x+1"), (True, "a\nb")]
    tasks = run(spark, "- [x] done\n  * [ ] sub\n1. [X] num\n- [y] no\n", markup.tasks)
    assert [(t[1], t[2]) for t in tasks] == [(True, "done"), (False, "sub"), (True, "num")]


def test_plain_text_and_escape(spark):
    text = "# T *x*\n\n**b** `a*b*c` [l](u)[^1]\n\n| a | b |\n|--|--|\n| 1 | 2 |\n\n[^1]: gone\n"
    assert run(spark, text, markup.plain_text) == "T x\nb a*b*c l\na b\n1 2"
    assert run(spark, "a < b && c", markup.html_escape) == "a &lt; b &amp;&amp; c"
    assert run(spark, "\"'/", markup.html_escape) == "&quot;&#x27;&#x2F;"


@pytest.mark.parametrize(
    "piece, feature, count",
    [
        ("> line\n", markup.alerts, 1),
        ("word word\n", markup.sections, 1),
        ("a|b\n", markup.table_cells, None),
        ("# h\n", markup.sections, None),
        ("text[^n] ", markup.footnotes, None),
        ("![a](u)\n", markup.images, 1),
    ],
)
def test_very_long_documents(spark, piece, feature, count):
    n = 20_000
    head = {markup.alerts: "> [!NOTE]\n", markup.table_cells: "a|b\n-|-\n"}.get(feature, "# top\n")
    tail = "\n\n```\n" + "code\n" * n + "```\n[^n]: note\n"
    got = run(spark, head + piece * n + tail, feature)
    assert len(got) == (count if count is not None else {"a|b\n": 2 * (n + 1), "# h\n": n + 1, "text[^n] ": n + 1}[piece])


PAGE = """<html><head><TITLE>A &amp; B</TITLE><!-- <meta property="og:title" content="no"> -->
<meta content='TW' name='twitter:title'><meta property="og:image" content="https://i/x.png">
<script>var m = '<meta property="og:title" content="no">'</script>
<meta name="description" content="D &lt;d&gt;"><link rel="icon" href="/f.ico"></head></html>"""


def test_link_cards(spark):
    df = spark.createDataFrame([("https://h.org:8080/p?q", PAGE), ("http://e.org/", "<p>none</p>")], "u string, h string")
    rows = df.select(html.link_card(html.page_meta(F.col("h")), F.col("u")).alias("c")).select("c.*").collect()
    assert tuple(rows[0]) == ("TW", "D <d>", "https://i/x.png", "https://h.org/f.ico")
    assert tuple(rows[1]) == ("e.org", "e.org", None, None)
