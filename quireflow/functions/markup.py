"""Features of Markdown documents as column expressions: text in, array of structs out.

Every feature is computed inside the document's own row with Spark's regular expressions and
array functions: no shuffle, and each text is read as a whole. Covered is the
CommonMark/GFM subset each function names; nested inline markup stays as text.
Fenced code is recognised first everywhere, so nothing inside a fence is taken for markup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Markdown syntax read here, as Java patterns.
FENCE_OPEN = r"^ {0,3}(?:(`{3,}+)[^\n`]*+|(~{3,}+)[^\n]*+)(?:\n|\z)"
BLOCK = rf"(?md){FENCE_OPEN}(?s:.*?)(?:^ {{0,3}}(?:\1`*|\2~*)[ \t]*$|\z)|^[^\n]*+$"
FENCE_BODY = r"(?s)^ {0,3}(`{3,}+|~{3,}+)[^\n]*(?:\n|\z)(.*?)(?:(?<=\n) {0,3}\1[`~]*[ \t]*)?\z"
HEADING = r"^ {0,3}#{1,6}(?:[ \t]|$)"
HEADING_ID = r"\{#([^}\s]+)\}[ \t]*$"
NOTE_DEFINITION = r"(?d)^ {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$"
NOTE_REFERENCE = r"\[\^([^\]\s]+)\]"
LINK_DEFINITION = r'^ {0,3}\[(?!\^)([^\]\n]+)\]:[ \t]*<?([^\s<>]+)>?(?:[ \t]+"([^"\n]*)")?[ \t]*$'
CODE_SPAN = r"(?<!`)(`+)(?!`)[^\n]*?(?<!`)\1(?!`)"
IMAGE = r'!\[([^\]\n]*)\]\([ \t]*<?([^\s()<>]+)>?(?:[ \t]+"([^"\n]*)")?[ \t]*\)'
INLINE_LINK = r'\[(?![\^!])([^\[\]\n]*)\]\([ \t]*<?([^\s()<>]+)>?(?:[ \t]+"([^"\n]*)")?[ \t]*\)'
REFERENCE_LINK = r"\[(?![\^!])([^\[\]\n]+)\]\[([^\[\]\n]*)\]"
WIKILINK = r"\[\[([^\[\]\n]+)\]\]"
AUTOLINK = r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>"
EMAIL = r"<([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)>"
BARE_URL = r"^https?://\S+$"
ALERT = r"^ {0,3}>[ \t]?\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\][ \t]*$"
QUOTE = r"^ {0,3}>"
TASK = r"(?d)^\s*(?:[-*+]|\d+[.)])[ \t]+\[([ xX])\][ \t]+(.*)$"
TABLE_RULE = r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"
DISPLAY_MATH = r"\$\$((?s:.+?))\$\$"
INLINE_MATH = r"(?<![\\$])\$(?![\s$])([^$\n]+?)(?<!\s)\$(?![\d$])"
NAME = r"[\p{IsAlphabetic}\p{N}_-]++"
QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|' + r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
ATTRIBUTE = rf"{NAME}(?:=(?:{QUOTED}|{NAME}))?"
ATTRIBUTE_BLOCK = rf"(?s)^\{{[ \t]*(?:{ATTRIBUTE}[ \t]*,?[ \t]*)*+\}}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often ``body`` uses it.

    A column that is only named in a projection may be copied by the optimizer to each of its
    uses, also into a lambda that runs per element; a lambda variable may not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def blocks(text: Column) -> Column:
    """The document as an array of whole code fences and single other lines."""
    return _all(F.replace(text, F.lit("\r\n"), F.lit("\n")), BLOCK)


def is_fence(block: Column) -> Column:
    return block.rlike(FENCE_OPEN)


def prose_lines(text: Column) -> Column:
    """All lines, with each code fence replaced by one empty line."""
    return F.transform(blocks(text), lambda b: F.when(is_fence(b), F.lit("")).otherwise(b))


def _is_definition(line: Column) -> Column:
    return line.rlike(NOTE_DEFINITION) | line.rlike(LINK_DEFINITION)


def prose(text: Column) -> Column:
    """Body text without fences, definitions and code spans."""
    body = F.filter(prose_lines(text), lambda line: ~_is_definition(line))
    return F.regexp_replace(F.array_join(body, "\n"), CODE_SPAN, " ")


def runs(lines: Column, inside: Callable[[Column], Column]) -> Column:
    """Maximal runs of consecutive lines that are ``inside``, each joined by newlines."""
    kept = F.transform(lines, lambda line: F.when(inside(line), line).otherwise(F.lit("\x00")))
    groups = F.transform(
        F.split(F.array_join(kept, "\n"), "\x00"), lambda g: F.regexp_replace(g, r"^\n|\n\z", "")
    )
    return F.filter(groups, lambda g: g != "")


def heading_id(title: Column) -> Column:
    """Each white space becomes a dash; case stays."""
    return F.regexp_replace(title, r"(?U)\s", "-")


def slug(text: Column) -> Column:
    """Lower case; letters, digits and dashes only."""
    return F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}-]", "")


def _title(heading: Column) -> Column:
    bare = F.regexp_replace(heading, r"^ {0,3}#{1,6}[ \t]*", "")
    bare = F.regexp_replace(bare, r"[ \t]*\{#[^}\s]+\}[ \t]*$", "")
    return F.rtrim(F.regexp_replace(bare, r"(?:^|[ \t]+)#+[ \t]*$", ""))


def sections(text: Column) -> Column:
    """(seq, level, id, title, content) per ATX heading; the content ends at the next one."""

    def with_blocks(bs: Column) -> Column:
        numbered = F.transform(bs, lambda b, i: F.struct(i.alias("i"), b.alias("b")))
        return let(F.filter(numbered, lambda x: x["b"].rlike(HEADING)), lambda ms: over(bs, ms))

    def over(bs: Column, ms: Column) -> Column:
        def section(m: Column, k: Column) -> Column:
            end = F.coalesce(F.get(ms, k + 1)["i"], F.size(bs))
            body = F.slice(bs, m["i"] + 2, end - m["i"] - 1)
            body = F.filter(body, lambda line: ~_is_definition(line))
            title = _title(m["b"])
            own = F.regexp_extract(m["b"], HEADING_ID, 1)
            return F.struct(
                k.alias("seq"),
                F.length(F.regexp_extract(m["b"], r"^ {0,3}(#+)", 1)).alias("level"),
                F.when(own != "", own).otherwise(heading_id(title)).alias("id"),
                title.alias("title"),
                F.regexp_replace(F.array_join(body, "\n"), r"^\n+|\n+\z", "").alias("content"),
            )

        return F.transform(ms, section)

    return let(blocks(text), with_blocks)


def code_blocks(text: Column) -> Column:
    """(seq, info, code, lines) per code fence."""

    def block(b: Column, i: Column) -> Column:
        code = F.regexp_extract(b, FENCE_BODY, 2)
        count = F.size(F.split(F.regexp_replace(code, r"\n\z", ""), "\n"))
        return F.struct(
            i.alias("seq"),
            F.trim(F.regexp_extract(b, r"^ {0,3}(?:`{3,}+|~{3,}+)([^\n]*)", 1)).alias("info"),
            code.alias("code"),
            F.when(code == "", 0).otherwise(count).alias("lines"),
        )

    return F.transform(F.filter(blocks(text), is_fence), block)


def fence_lang(info: Column) -> Column:
    """The leading name of a fence's info text, or null."""
    return _null_if_empty(F.regexp_extract(info, rf"^{NAME}", 0))


def _unescape(quoted: Column) -> Column:
    """Text between the quotes with its escapes resolved; unknown escapes stay."""
    inside = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    body = F.replace(inside, F.lit("\\\\"), F.lit("\x00"))
    quote = F.substring(quoted, 1, 1)
    body = F.replace(body, F.concat(F.lit("\\"), quote), quote)
    for have, want in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\x00", "\\")):
        body = F.replace(body, F.lit(have), F.lit(want))
    return body


def fence_attributes(info: Column) -> Column:
    """(key, value, type) of ``{k=v, flag, k="q"}`` after the language.

    A bare flag is the boolean true; unquoted values are booleans or integers if they
    read as such; a repeated key keeps its last value.
    """
    rest = F.ltrim(F.regexp_replace(info, rf"^{NAME}", ""))
    inner = F.regexp_extract(rest, ATTRIBUTE_BLOCK, 0)
    tokens = _all(F.regexp_replace(inner, r"^\{", ""), ATTRIBUTE)

    def pair(token: Column) -> Column:
        raw = F.regexp_extract(token, rf"(?s)^{NAME}=(.*)$", 1)
        quoted = raw.rlike("^[\"']")
        flag = ~token.contains("=")
        boolean = raw.isin("true", "false")
        integer = raw.rlike(r"^-?\d+$") & raw.try_cast("bigint").isNotNull()
        return F.struct(
            F.regexp_extract(token, rf"^{NAME}", 0).alias("key"),
            F.when(flag, "true").when(quoted, _unescape(raw)).otherwise(raw).alias("value"),
            F.when(flag, "boolean")
            .when(quoted, "string")
            .when(boolean, "boolean")
            .when(integer, "integer")
            .otherwise("string")
            .alias("type"),
        )

    def last_of_key(pairs: Column) -> Column:
        def kept(p: Column, i: Column) -> Column:
            later = F.slice(pairs, i + 2, F.size(pairs))
            return ~F.exists(later, lambda q: q["key"] == p["key"])

        return F.filter(pairs, kept)

    return let(F.transform(tokens, pair), last_of_key)


def attribute(attributes: Column, key: str) -> Column:
    return F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"]


def alerts(text: Column) -> Column:
    """(seq, kind, text) per quote that opens with ``[!NOTE]`` or another alert tag."""
    quotes = runs(prose_lines(text), lambda line: line.rlike(QUOTE))
    opened = F.filter(quotes, lambda q: F.substring_index(q, "\n", 1).rlike(ALERT))

    def alert(q: Column, i: Column) -> Column:
        body = F.regexp_replace(q, r"^[^\n]*\n?", "")
        return F.struct(
            i.alias("seq"),
            F.lower(F.regexp_extract(F.substring_index(q, "\n", 1), ALERT, 1)).alias("kind"),
            F.regexp_replace(body, r"(?md)^ {0,3}>[ \t]?", "").alias("text"),
        )

    return F.transform(opened, alert)


def footnotes(text: Column) -> Column:
    """(part, seq, id, number, content) of footnote definitions and references.

    A footnote's number is the place of its first reference among all references that
    have a definition, so repeats leave gaps. References in the body come before
    those inside definitions. An unresolved reference has no number and no content.
    """

    def with_lines(lines: Column) -> Column:
        definitions = F.transform(
            F.filter(lines, lambda line: line.rlike(NOTE_DEFINITION)),
            lambda line: F.struct(
                F.regexp_extract(line, NOTE_DEFINITION, 1).alias("id"),
                F.regexp_extract(line, NOTE_DEFINITION, 2).alias("content"),
            ),
        )
        body = F.array_join(F.filter(lines, lambda line: ~line.rlike(NOTE_DEFINITION)), "\n")
        return let(definitions, lambda ds: with_definitions(body, ds))

    def with_definitions(body: Column, ds: Column) -> Column:
        whole = F.concat_ws("\n", body, F.array_join(ds["content"], "\n"))
        refs = _all(F.regexp_replace(whole, CODE_SPAN, " "), NOTE_REFERENCE, 1)
        return let(refs, lambda rs: let(_known(rs, ds), lambda known: rows(ds, rs, known)))

    def _known(rs: Column, ds: Column) -> Column:
        ids = F.array_intersect(F.array_distinct(rs), ds["id"])
        return let(ids, lambda defined: F.filter(rs, lambda r: F.array_contains(defined, r)))

    def rows(ds: Column, rs: Column, known: Column) -> Column:
        def number(id_: Column) -> Column:
            return F.nullif(F.array_position(known, id_), F.lit(0)).cast("int")

        def content(id_: Column) -> Column:
            same = F.filter(ds, lambda d: d["id"] == id_)
            return F.get(same, F.size(same) - 1)["content"]

        of_definitions = F.transform(
            ds,
            lambda d, i: F.struct(
                F.lit("definition").alias("part"),
                i.alias("seq"),
                d["id"].alias("id"),
                number(d["id"]).alias("number"),
                d["content"].alias("content"),
            ),
        )
        of_references = F.transform(
            rs,
            lambda r, i: F.struct(
                F.lit("reference").alias("part"),
                i.alias("seq"),
                r.alias("id"),
                number(r).alias("number"),
                content(r).alias("content"),
            ),
        )
        return F.concat(of_definitions, of_references)

    return let(prose_lines(text), with_lines)


def images(text: Column) -> Column:
    """(url, title, alt), each URL of a document once, at its first use."""
    tokens = _all(prose(text), IMAGE)

    def image(token: Column) -> Column:
        return F.struct(
            F.regexp_extract(token, IMAGE, 2).alias("url"),
            F.regexp_extract(token, IMAGE, 3).alias("title"),
            F.regexp_extract(token, IMAGE, 1).alias("alt"),
        )

    def first_of_url(found: Column) -> Column:
        urls = F.array_distinct(found["url"])
        return F.transform(urls, lambda u: F.get(F.filter(found, lambda f: f["url"] == u), F.lit(0)))

    return let(F.transform(tokens, image), first_of_url)


def links(text: Column) -> Column:
    """(seq, href, title, text, kind); kind is normal, autolink, email, wikilink or broken."""
    token = "|".join((IMAGE, WIKILINK, INLINE_LINK, REFERENCE_LINK, AUTOLINK, EMAIL, BARE_URL))
    found = F.filter(_all(prose(text), f"(?md){token}"), lambda t: ~t.startswith("!"))
    definitions = F.transform(
        F.filter(prose_lines(text), lambda line: line.rlike(LINK_DEFINITION)),
        lambda line: F.struct(
            F.lower(F.regexp_extract(line, LINK_DEFINITION, 1)).alias("name"),
            F.regexp_extract(line, LINK_DEFINITION, 2).alias("href"),
            F.regexp_extract(line, LINK_DEFINITION, 3).alias("title"),
        ),
    )

    def kind_of(t: Column) -> Column:
        return (
            F.when(t.startswith("[["), "wikilink")
            .when(t.rlike(f"^{EMAIL}$"), "email")
            .when(t.startswith("<") | t.startswith("http"), "autolink")
            .when(t.endswith(")"), "normal")
            .otherwise("reference")
        )

    def link(ds: Column, t: Column, i: Column) -> Column:
        kind = kind_of(t)
        label = F.regexp_extract(t, REFERENCE_LINK, 1)
        name = F.regexp_extract(t, REFERENCE_LINK, 2)
        wanted = F.lower(F.when(name != "", name).otherwise(label))
        target = F.get(F.filter(ds, lambda d: d["name"] == wanted), F.lit(0))
        bare = F.regexp_replace(t, "^<|>$", "")
        wiki = F.regexp_extract(t, WIKILINK, 1)
        return F.struct(
            i.alias("seq"),
            F.when(kind == "wikilink", wiki)
            .when(kind == "normal", F.regexp_extract(t, INLINE_LINK, 2))
            .when(kind == "reference", F.coalesce(target["href"], F.lit("")))
            .otherwise(bare)
            .alias("href"),
            F.when(kind == "normal", F.regexp_extract(t, INLINE_LINK, 3))
            .when(kind == "reference", F.coalesce(target["title"], F.lit("")))
            .when(t.startswith("http"), t)
            .otherwise("")
            .alias("title"),
            F.when(kind == "wikilink", wiki)
            .when(kind == "normal", F.regexp_extract(t, INLINE_LINK, 1))
            .when(kind == "reference", label)
            .otherwise(bare)
            .alias("text"),
            F.when(kind != "reference", kind)
            .when(target.isNull(), "broken")
            .otherwise("normal")
            .alias("kind"),
        )

    return let(definitions, lambda ds: F.transform(found, lambda t, i: link(ds, t, i)))


def paragraphs(text: Column) -> Column:
    """Runs of non-blank prose lines."""
    return runs(prose_lines(text), lambda line: ~line.rlike(r"^\s*$"))


def isolated_links(text: Column) -> Column:
    """Distinct URLs that make up a paragraph of their own, bare or in angle brackets."""
    bare = F.transform(paragraphs(text), lambda p: F.regexp_replace(F.trim(p), "^<|>$", ""))
    return F.array_distinct(F.filter(bare, lambda p: p.rlike(r"^https?://[^\s<>]+\z")))


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(c))


def table_cells(text: Column) -> Column:
    """(table_seq, row, col, align, text) of pipe tables; row 0 is the header.

    Rows are cut or filled to the header's width, as in GFM.
    """

    def parse(group: Column) -> Column:
        lines = F.split(group, "\n")
        rule = F.array_position(F.transform(lines, lambda x: x.rlike(TABLE_RULE)), True).cast("int")
        header = _cells(F.get(lines, rule - 2))
        marks = _cells(F.get(lines, rule - 1))
        body = F.slice(lines, rule + 1, F.size(lines))
        valid = (rule >= 2) & (F.size(header) == F.size(marks))
        rows = F.concat(F.array(header), F.transform(body, _cells))
        return F.when(valid, F.struct(marks.alias("marks"), rows.alias("rows")))

    groups = runs(prose_lines(text), lambda line: line.contains("|"))
    tables = F.filter(
        F.transform(groups, lambda g: F.when(F.size(F.split(g, "\n")) >= 2, parse(g))),
        lambda t: t.isNotNull(),
    )

    def align(mark: Column) -> Column:
        left, right = mark.startswith(":"), mark.endswith(":")
        return F.when(left & right, "center").when(left, "left").when(right, "right").otherwise("none")

    def cells(t: Column, n: Column) -> Column:
        return F.flatten(
            F.transform(
                t["rows"],
                lambda row, r: F.transform(
                    t["marks"],
                    lambda mark, c: F.struct(
                        n.alias("table_seq"),
                        r.alias("row"),
                        c.alias("col"),
                        align(mark).alias("align"),
                        F.coalesce(F.get(row, c), F.lit("")).alias("text"),
                    ),
                ),
            )
        )

    return F.flatten(F.transform(tables, cells))


def tasks(text: Column) -> Column:
    """(seq, checked, text) per task list item."""
    items = F.filter(prose_lines(text), lambda line: line.rlike(TASK))
    return F.transform(
        items,
        lambda line, i: F.struct(
            i.alias("seq"),
            (F.lower(F.regexp_extract(line, TASK, 1)) == "x").alias("checked"),
            F.regexp_extract(line, TASK, 2).alias("text"),
        ),
    )


def math_spans(text: Column) -> Column:
    """(seq, display, source) per ``$$…$$`` or ``$…$``."""
    found = _all(prose(text), f"{DISPLAY_MATH}|{INLINE_MATH}")

    def span(m: Column, i: Column) -> Column:
        display = m.startswith("$$")
        return F.struct(
            i.alias("seq"),
            display.alias("display"),
            F.trim(F.regexp_replace(m, r"^\$\$?\n?|\n?\$\$?\z", "")).alias("source"),
        )

    return F.transform(found, span)


# Inline markup and, in its groups, the text that stays of it.
INLINE = "|".join(
    (
        r"(?<!`)(`+)(?!`)([^\n]*?)(?<!`)\1(?!`)",
        r"!\[([^\]\n]*)\]\([^()\n]*\)",
        WIKILINK,
        r"\[(?![\^!])([^\[\]\n]*)\]\([^()\n]*\)",
        r"\[(?![\^!])([^\[\]\n]+)\]\[[^\[\]\n]*\]",
        AUTOLINK,
        EMAIL,
        r"\[\^[^\]\s]+\]",
        INLINE_MATH,
    )
)
INLINE_TEXT = "$2$3$4$5$6$7$8$9"
# A line without any of this holds no markup.
MARKED = r"[#>\[\]!$|*_~`<:=+-]|^\s*\d"


def _plain_line(line: Column) -> Column:
    steps = (
        (r"^\s*\$\$\s*$", ""),
        (TABLE_RULE, ""),
        (r"^ {0,3}#{1,6}[ \t]+", ""),
        (r"[ \t]*\{#[^}\s]+\}[ \t]*$", ""),
        (r"^(?: {0,3}>[ \t]?)+", ""),
        (r"^\[!(?:NOTE|TIP|IMPORTANT|WARNING|CAUTION)\][ \t]*$", ""),
        (r"^\s*(?:[-*+]|\d+[.)])[ \t]+(?:\[[ xX]\][ \t]+)?", ""),
        (r"^[ \t]*\|[ \t]*|[ \t]*\|[ \t]*$", ""),
        (r"[ \t]*\|[ \t]*", " "),
        (INLINE, INLINE_TEXT),
        (r"(?d)(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", "$2"),
        (r"(?<![\w*])\*(?=\S)([^*\n]+?)(?<=\S)\*(?!\*)", "$1"),
    )
    plain = line
    for pattern, to in steps:
        plain = F.regexp_replace(plain, pattern, to)
    return F.trim(F.when(line.rlike(MARKED), plain).otherwise(line))


def plain_text(text: Column) -> Column:
    """The text without its markup, one line per line that holds any."""
    body = F.filter(blocks(text), lambda b: ~_is_definition(b))
    plain = F.transform(
        body,
        lambda b: F.when(
            is_fence(b), F.regexp_replace(F.regexp_extract(b, FENCE_BODY, 2), r"\n\z", "")
        ).otherwise(_plain_line(b)),
    )
    return F.array_join(F.filter(plain, lambda p: p != ""), "\n")


# Characters escaped in stored code text, the ampersand first.
HTML_ESCAPES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
    ("/", "&#x2F;"),
)


def html_escape(text: Column) -> Column:
    for char, entity in HTML_ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
