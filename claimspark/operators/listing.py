"""Listing pages: link cards, badges, the end of the archive, first occurrence per URL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark import domain
from claimspark.functions.html import anchors
from claimspark.functions.labels import detect_label, strip_badge
from claimspark.functions.urls import absolute_url
from claimspark.operators.keyed import keep_first
from claimspark.session import stage

MIN_CARD_CHARS = 30


def page_links(pages: DataFrame, href_pattern: str, key: str = "listing_page") -> DataFrame:
    """``(key, pos, href, text)`` of the matching links of each page."""
    links = pages.select(key, F.explode(anchors(F.col("html"), href_pattern)).alias("link"))
    return links.select(key, "link.*")


def without_nav(cards: DataFrame, min_chars: int = MIN_CARD_CHARS) -> DataFrame:
    """Drop short link texts; the badge still counts towards the length."""
    return cards.filter(F.length("text") >= min_chars)


def labelled_cards(
    cards: DataFrame, base: str, labels: Sequence[str] = domain.LISTING_BADGES
) -> DataFrame:
    """Absolute URL, detected badge and the card text without its leading badge."""
    found = cards.withColumn("verdict", detect_label(F.col("text"), labels))
    body = F.coalesce(strip_badge(F.col("text"), F.col("verdict"), labels), F.col("text"))
    return found.select(
        absolute_url(F.col("href"), base).alias("url"),
        "verdict",
        body.alias("card_text"),
        "listing_page",
        "pos",
    )


def _within(pages: DataFrame, max_pages: int | None) -> DataFrame:
    kept = pages.filter(F.col("listing_page") >= 0)
    return kept if max_pages is None else kept.filter(F.col("listing_page") < max_pages)


def archive_end(page_counts: DataFrame, max_pages: int | None = None) -> DataFrame:
    """One row ``stop``: pages from there on are past the end of the archive.

    ``page_counts`` holds ``(listing_page, n_cards)`` of the pages that exist. The archive ends
    at the first absent page or at the second of two consecutive pages without cards. Neighbours
    meet by equi-joins on the page number, so no task orders all pages.
    """
    counts = _within(page_counts, max_pages)
    number = F.col("listing_page")
    reached = counts.select((number + 1).alias("listing_page"))
    start = reached.sparkSession.range(1).select(F.lit(0).cast("long").alias("listing_page"))
    absent = reached.unionByName(start).join(counts, "listing_page", "left_anti")
    empty = counts.filter("n_cards = 0").select("listing_page")
    after_empty = empty.select((number + 1).alias("listing_page"))
    streak = empty.join(after_empty, "listing_page", "left_semi")
    ends = absent.select("listing_page").unionByName(streak)
    # There is always a first absent page, as pages are finitely many.
    limit = F.lit(max_pages).cast("long")
    return ends.agg(F.least(F.min("listing_page"), limit).cast("long").alias("stop"))


def within_archive(cards: DataFrame, page_counts: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Cards of the pages before the end of the archive."""
    stop = archive_end(page_counts, max_pages).scalar()
    return cards.filter((F.col("listing_page") >= 0) & (F.col("listing_page") < stop))


def listing_cards(
    pages: DataFrame,
    base: str,
    href_pattern: str,
    max_pages: int | None = None,
    labels: Sequence[str] = domain.LISTING_BADGES,
    min_chars: int = MIN_CARD_CHARS,
) -> DataFrame:
    """``(url, verdict, card_text, listing_page)`` from ``(listing_page, html)``.

    The cards are parsed once and staged, since both the end of the archive and the result read
    them.
    """
    wanted = _within(pages, max_pages).filter("html is not null")
    linked = wanted.select(
        "listing_page", anchors(F.col("html"), href_pattern).alias("_links")
    )
    carded = linked.select(
        "listing_page", F.filter("_links", lambda c: F.length(c["text"]) >= min_chars).alias("_links")
    )
    carded = stage(carded, "cards")
    counts = carded.select("listing_page", F.array_size("_links").alias("n_cards"))
    cards = carded.select("listing_page", F.explode("_links").alias("link"))
    rows = labelled_cards(cards.select("listing_page", "link.*"), base, labels)
    rows = within_archive(rows, counts, max_pages)
    return keep_first(rows, "url", ["listing_page", "pos"]).drop("pos")


def choose_urls(listing: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Listing URLs, or the sitemap's when the listing is empty, decided inside one plan."""
    listed = listing.select("url")
    return listed.unionByName(sitemap.select("url").filter(~listed.select(F.lit(1).alias("one")).exists()))
