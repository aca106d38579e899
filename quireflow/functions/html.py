"""Head metadata of HTML pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow.functions.markup import let

# Entities decoded in titles and attribute values, the ampersand last.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&amp;", "&"),
)

HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
META = r"(?is)<meta\b[^>]*>"
LINK = r"(?is)<link\b[^>]*>"


def decode(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag; null if the tag has none of that name."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(pattern), decode(found))


def page_meta(page: Column) -> Column:
    """struct(props, title, description, icon) of a page's HTML.

    ``props`` lists the og: and twitter: metas as (name, value), in page order.
    """

    def of_visible(html: Column) -> Column:
        metas = F.regexp_extract_all(html, F.lit(META), F.lit(0))
        links = F.regexp_extract_all(html, F.lit(LINK), F.lit(0))

        def prop(tag: Column) -> Column:
            og, tw = attribute(tag, "property"), attribute(tag, "name")
            name = F.when(og.startswith("og:"), og).when(tw.startswith("twitter:"), tw)
            value = attribute(tag, "content")
            return F.when(
                name.isNotNull() & value.isNotNull(), F.struct(name.alias("name"), value.alias("value"))
            )

        described = F.filter(metas, lambda t: attribute(t, "name") == "description")
        icons = F.filter(links, lambda t: attribute(t, "rel").startswith("icon"))
        first = F.lit(0)
        return F.struct(
            F.filter(F.transform(metas, prop), lambda p: p.isNotNull()).alias("props"),
            F.when(html.rlike(TITLE), decode(F.regexp_extract(html, TITLE, 1))).alias("title"),
            attribute(F.get(described, first), "content").alias("description"),
            attribute(F.get(icons, first), "href").alias("icon"),
        )

    return let(F.regexp_replace(page, HIDDEN, ""), of_visible)


def prop(meta: Column, name: str) -> Column:
    """Value of a property; the last one if the page repeats it."""
    same = F.filter(meta["props"], lambda p: p["name"] == name)
    return F.get(same, F.size(same) - 1)["value"]


def host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), url)


def absolute(icon: Column, url: Column) -> Column:
    """An icon's address; a relative one is put after the page's scheme and host."""
    base = F.concat(
        F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("HOST"))
    )
    return F.when(icon.rlike("^https?://"), icon).otherwise(F.concat(base, icon))


def link_card(meta: Column, url: Column) -> Column:
    """struct(title, description, image, favicon) of a page for a link to it."""
    favicon = absolute(meta["icon"], url)
    return F.struct(
        F.coalesce(prop(meta, "og:title"), prop(meta, "twitter:title"), meta["title"], host(url)).alias(
            "title"
        ),
        F.coalesce(
            prop(meta, "og:description"),
            prop(meta, "twitter:description"),
            meta["description"],
            host(url),
        ).alias("description"),
        F.coalesce(prop(meta, "og:image"), prop(meta, "twitter:image"), favicon).alias("image"),
        favicon.alias("favicon"),
    )
