"""Link cards and other look-ups by key with a default."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions import html
from quireflow.operators.joins import key_join


def page_cards(pages: DataFrame, url: str, body: str) -> DataFrame:
    """(url, title, description, image, favicon), one row per URL.

    Of several captures of a URL the greatest card is kept, whatever their order; it is chosen on
    the map side first.
    """
    meta = pages.select(F.col(url).alias("url"), html.page_meta(F.col(body)).alias("m"))
    cards = meta.select("url", html.link_card(F.col("m"), F.col("url")).alias("card"))
    return cards.groupBy("url").agg(F.max("card").alias("card")).select("url", "card.*")


def link_cards(links: DataFrame, key: Sequence[str], cards: DataFrame) -> DataFrame:
    """(key…, url, resolved, title, description, image, favicon) per isolated link.

    Pages that were not crawled leave the link unresolved. One URL may be linked from
    very many documents, which adaptive execution splits.
    """
    known = cards.withColumn("resolved", F.lit(True))
    joined = key_join(links, known, ["url"], "left")
    return joined.withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def lookup(
    rows: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    defaults: Mapping[str, Column],
) -> DataFrame:
    """Left join on a key that is unique in ``dimension``, with defaults for what is missing."""
    joined = key_join(rows, dimension, on, "left")
    for name, default in defaults.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), default))
    return joined
