"""Sitemaps: an index, its children and their URL entries as a ``(url, lastmod)`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions.html import decode_entities
from claimspark.functions.text import strip_space
from claimspark.operators.keyed import keep_first

URL_SCHEMA = "loc string, lastmod string"


def _elements(xml: Column, tag: str) -> Column:
    clean = F.regexp_replace(xml, r"(?s)<!--.*?-->", "")
    return F.regexp_extract_all(clean, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), F.lit(1))


def _text(xml: Column, tag: str) -> Column:
    raw = F.try_element_at(_elements(xml, tag), F.lit(1))
    return decode_entities(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))


def sitemap_urls(docs: DataFrame, root: str, path_filter: str) -> DataFrame:
    """URL entries of the sitemap at ``root`` and of the sitemaps it lists.

    ``docs`` holds ``(url, xml)``. Entries of the root come first, then those of each child in
    listed order; only locations containing ``path_filter`` stay, the first of a repeat wins.
    An absent root gives an empty table.
    """
    index = docs.filter(F.col("url") == root).select("xml")
    children = index.select(F.posexplode(_elements(F.col("xml"), "sitemap")).alias("_doc", "_entry"))
    children = children.select((F.col("_doc") + 1).alias("_doc"), _text(F.col("_entry"), "loc").alias("url"))
    listed = index.select(F.lit(0).alias("_doc"), "xml").unionByName(
        children.join(docs, "url").select("_doc", "xml")
    )
    entries = listed.select("_doc", F.posexplode(_elements(F.col("xml"), "url")).alias("_pos", "_entry"))
    rows = entries.select(
        strip_space(_text(F.col("_entry"), "loc")).alias("url"),
        strip_space(_text(F.col("_entry"), "lastmod")).alias("lastmod"),
        "_doc",
        "_pos",
    ).filter(F.col("url").contains(path_filter))
    return keep_first(rows, "url", ["_doc", "_pos"]).select("url", "lastmod")


def read_url_set(spark: SparkSession, path: str, path_filter: str) -> DataFrame:
    """URL entries straight from sitemap files, one row per ``<url>`` element; the first of a repeat stays.

    First by file name, then by byte range, then within the range.
    """
    rows = spark.read.format("xml").option("rowTag", "url").schema(URL_SCHEMA).load(path)
    place = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    ).alias("_place")
    rows = rows.select(strip_space(F.col("loc")).alias("url"), strip_space(F.col("lastmod")).alias("lastmod"), place)
    return keep_first(rows.filter(F.col("url").contains(path_filter)), "url", "_place").drop("_place")
