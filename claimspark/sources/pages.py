"""Page tables: HTML by URL, and the keys pages are stored under."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions.urls import page_key


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(url, html)`` of a crawled page table."""
    return spark.read.parquet(path).select("url", "html")


def lookup_pages(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """HTML for each URL; an absent page gives a null."""
    return urls.join(pages.select("url", "html"), "url", "left")


def with_page_key(df: DataFrame, url: str = "url", max_chars: int = 150) -> DataFrame:
    return df.withColumn("page_key", page_key(F.col(url), max_chars))


def key_collisions(df: DataFrame, url: str = "url", max_chars: int = 150) -> DataFrame:
    """Keys shared by more than one distinct URL, with the number of URLs."""
    distinct = with_page_key(df.select(url).distinct(), url, max_chars)
    return distinct.groupBy("page_key").agg(F.count("*").alias("n_urls")).filter("n_urls > 1")
