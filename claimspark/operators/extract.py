"""Page records: structured data first, HTML fallbacks second."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark import domain
from claimspark.functions.html import first_filled, meta_content, title_text, visible_text
from claimspark.functions.labels import detect_label
from claimspark.operators.jsonld import has_markup, jsonld_nodes, structured_fields

DATE_META = "article:published_time"
TITLE_META = "og:title"


def structured_records(pages: DataFrame) -> DataFrame:
    """``(url, claim_reviewed, claimant, rating, date_jsonld, headline, keywords, jsonld_types)``."""
    nodes = pages.select("url", jsonld_nodes(F.col("html")).alias("_nodes"))
    return nodes.select("url", *structured_fields(F.col("_nodes")))


def harvest_rows(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Claim fields of each page. The date is JSON-LD or the meta tag, never free text.

    ``keep`` names further page columns to carry along.
    """
    html = F.col("html")
    meta = meta_content(html, DATE_META).alias("_meta_date")
    nodes = pages.select("url", *keep, jsonld_nodes(html).alias("_nodes"), meta)
    rows = nodes.select("url", *keep, "_meta_date", *structured_fields(F.col("_nodes")))
    return rows.select(
        "url",
        *keep,
        "claim_reviewed",
        "rating",
        first_filled(F.col("date_jsonld"), F.col("_meta_date")).alias("pub_date"),
        "jsonld_types",
        has_markup(F.col("jsonld_types")).alias("has_claimreview"),
    )


def article_sample(
    pages: DataFrame,
    site_suffix: str | None = None,
    labels: Sequence[str] = domain.LISTING_BADGES,
    label_chars: int = 3000,
) -> DataFrame:
    """Title, date, verdict, claim, claimant, tags and types of each page that has HTML.

    The verdict is the markup rating, else the first known label in the opening
    ``label_chars`` characters of the visible text.
    """
    html = F.col("html")
    filled = pages.filter(html.isNotNull() & (html != ""))
    nodes = filled.select("url", "html", jsonld_nodes(html).alias("_nodes"))
    rows = nodes.select("url", "html", *structured_fields(F.col("_nodes")))

    def lacking(field: str, fallback: Column) -> Column:
        return F.when(F.col(field).isNull(), fallback)

    # The fallbacks are only worked out for pages that lack the field, and the text is its own
    # column because the label search looks at it once per label.
    rows = rows.select(
        *[c for c in rows.columns if c != "html"],
        lacking("headline", first_filled(meta_content(html, TITLE_META), title_text(html, site_suffix))).alias("_title"),
        lacking("date_jsonld", meta_content(html, DATE_META)).alias("_date"),
        lacking("rating", F.substring(visible_text(html), 1, label_chars)).alias("_opening"),
    )
    return rows.select(
        "url",
        F.coalesce("headline", "_title").alias("title"),
        F.coalesce("date_jsonld", "_date").alias("pub_date_raw"),
        F.coalesce("rating", detect_label(F.col("_opening"), labels)).alias("verdict_in_page"),
        "claim_reviewed",
        "claimant",
        F.col("keywords").alias("tags"),
        "jsonld_types",
    )
