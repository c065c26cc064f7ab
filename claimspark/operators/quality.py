"""Quality of a crawl: value shares, fill rates, date plausibility, one long summary table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.dates import wall_clock
from claimspark.operators.jsonld import has_markup


def _share(condition: Column) -> Column:
    """Share of rows, nulls counting as no; null on an empty input."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def value_counts(df: DataFrame, col: str, dropna: bool = False) -> DataFrame:
    """``(value, n, pct)``; null is a value unless ``dropna``, percent of all rows."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    shown = counts.filter("value is not null") if dropna else counts
    return shown.select("value", "n", (F.col("n") * 100.0 / total).alias("pct"))


def null_alarm(df: DataFrame, col: str, limit: float = 0.10) -> DataFrame:
    """Share of nulls and whether it is above the limit."""
    share = _share(F.col(col).isNull())
    return df.agg(share.alias("null_share"), (share > limit).alias("warn"))


def date_range(df: DataFrame, col: str, zone: str = "UTC") -> DataFrame:
    """First and last parsable day."""
    day = wall_clock(F.col(col), zone).cast("date")
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def fill_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, share)`` of non-null values, from one aggregate."""
    row = df.agg(*[_share(F.col(c).isNotNull()).alias(c) for c in cols])
    return row.unpivot([], list(cols), "column", "share")


def markup_coverage(
    df: DataFrame, col: str = "jsonld_types", name: str = "ClaimReview", limit: float = 0.5
) -> DataFrame:
    """Share of rows whose types contain a name; ``recommend`` above the limit."""
    share = _share(has_markup(F.col(col), name))
    return df.agg(share.alias("coverage"), (share > limit).alias("recommend"))


def date_plausibility(df: DataFrame, col: str, as_of: str, limit: float = 0.5) -> DataFrame:
    """Distinct parsable times, their range, and the share falling on ``as_of`` (UTC).

    Warns when more than ``limit`` fall on that day or at most two times are distinct: a fill
    rate alone does not show a field that is always wrong.
    """
    at = wall_clock(F.col(col), "UTC")
    parsed = df.select(at.alias("_at")).filter("_at is not null")
    # Count each time once per map task before the shuffle, then once over all.
    times = parsed.groupBy("_at").agg(F.count("*").alias("_n"))
    today = F.col("_at").cast("date") == F.lit(as_of).cast("date")
    total = F.sum("_n")
    same = F.coalesce(F.try_divide(F.sum(F.when(today, F.col("_n")).otherwise(0)), total), F.lit(0.0))
    distinct = F.count("*")
    return times.agg(
        distinct.alias("n_distinct"),
        F.min("_at").cast("date").alias("first_day"),
        F.max("_at").cast("date").alias("last_day"),
        same.alias("as_of_share"),
        ((distinct > 0) & ((same > limit) | (distinct <= 2))).alias("warn"),
    )


SAMPLE_FIELDS = ("title", "pub_date_raw", "claim_reviewed", "claimant", "tags")


def recon_summary(
    listing: DataFrame, sitemap: DataFrame, sample: DataFrame, as_of: str
) -> DataFrame:
    """All checks as one long ``(section, metric, value)`` table of texts, shares to four digits.

    Each input is aggregated as few times as possible: the listing once by verdict, the sitemap
    once, the sample once for its rates and once by date.
    """

    def long(df: DataFrame, section: str) -> DataFrame:
        shown = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        texts = df.select(*shown).select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        out = texts.unpivot([], texts.columns, "metric", "value")
        return out.select(F.lit(section).alias("section"), "metric", "value")

    verdicts = listing.groupBy("verdict").agg(F.count("*").alias("n"))
    rows = F.coalesce(F.sum("n"), F.lit(0))
    missing = F.try_divide(F.sum(F.when(F.col("verdict").isNull(), F.col("n")).otherwise(0)), rows)
    shares = verdicts.select("verdict", "n", (F.col("n") * 100.0 / verdicts.agg(rows).scalar()).alias("pct"))
    shown = shares.select(
        F.lit("verdicts").alias("section"),
        F.coalesce("verdict", F.lit("None")).alias("metric"),
        F.concat("n", F.lit(" ("), F.format_number("pct", 1), F.lit("%)")).alias("value"),
    )
    cards = verdicts.agg(
        rows.alias("n_listing"), missing.alias("verdict_null_share"), (missing > 0.10).alias("verdict_warn")
    )
    day = wall_clock(F.col("lastmod"), "UTC").cast("date")
    site = sitemap.agg(F.count("*").alias("n_sitemap"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    coverage = _share(has_markup(F.col("jsonld_types")))
    rates = sample.agg(
        F.count("*").alias("n_sample"),
        *[_share(F.col(c).isNotNull()).alias(f"{c}_filled") for c in SAMPLE_FIELDS],
        coverage.alias("markup_coverage"),
        (coverage > 0.5).alias("markup_recommend"),
    )
    dates = date_plausibility(sample, "pub_date_raw", as_of)
    return (
        long(cards, "listing")
        .unionByName(shown)
        .unionByName(long(site, "sitemap"))
        .unionByName(long(rates, "sample"))
        .unionByName(long(dates, "dates"))
    )
