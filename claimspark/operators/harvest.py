"""Incremental harvest: what is pending, what a page yields, how results are merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark import domain
from claimspark.operators.extract import harvest_rows
from claimspark.operators.jsonld import has_markup
from claimspark.operators.keyed import keep_first, keep_last


def load_targets(cards: DataFrame, order: str | Sequence[str] = "seq") -> DataFrame:
    """``(url, verdict, order)``, the first row of each URL."""
    order = [order] if isinstance(order, str) else list(order)
    return keep_first(cards.select("url", "verdict", *order), "url", order)


def pending(targets: DataFrame, done: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Targets not harvested yet. A failed page left a row and counts as done, unless retried."""
    if retry_failed:
        done = done.filter(F.col("claim_reviewed").isNotNull())
    return targets.join(done.select("url"), "url", "left_anti")


def head(df: DataFrame, n: int, order: str | Sequence[str] = "seq") -> DataFrame:
    """The first ``n`` rows in order."""
    return df.orderBy(*([order] if isinstance(order, str) else order)).limit(n)


def harvest(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Claim rows of the targets; a missing page gives nulls and ``has_claimreview = false``.

    Pages are reduced to their few claim fields before the join, so HTML is never shuffled.
    """
    return attach_claims(targets, harvest_rows(pages.filter("html is not null")))


def attach_claims(targets: DataFrame, harvested: DataFrame, how: str = "left") -> DataFrame:
    """Join targets with harvested page rows into claim rows."""
    rows = targets.join(harvested, "url", how)
    flag = has_markup(F.col("jsonld_types")).alias("has_claimreview")
    return rows.select(*[flag if c == "has_claimreview" else c for c in domain.CLAIM_COLUMNS])


def upsert(
    done: DataFrame,
    new: DataFrame,
    key: str = "url",
    order: str | Sequence[str] = (),
    columns: Sequence[str] = domain.CLAIM_COLUMNS,
) -> DataFrame:
    """Append ``new`` and keep the newest row per key; ``order`` ranks rows within one side."""
    order = [order] if isinstance(order, str) else list(order)
    wanted = [*columns, *[c for c in order if c not in columns]]
    both = done.select(*wanted, F.lit(0).alias("_gen")).unionByName(
        new.select(*wanted, F.lit(1).alias("_gen"))
    )
    return keep_last(both, key, ["_gen", *order]).select(*columns)


def progress(claims: DataFrame) -> DataFrame:
    """Rows, filled claims and their share."""
    filled = F.count("claim_reviewed")
    rows = F.count("*")
    share = F.coalesce(F.try_divide(filled, rows), F.lit(0.0)).alias("fill_share")
    return claims.agg(rows.alias("n_rows"), filled.alias("n_filled"), share)
