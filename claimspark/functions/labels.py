"""Label columns: badge detection and removal, exact rewrites, the binary target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark import domain
from claimspark.functions.text import contains_word, strip_space


def detect_label(text: Column, labels: Sequence[str] = domain.LISTING_BADGES) -> Column:
    """First label *of the list* that occurs as a whole word; list order beats text order."""
    return F.coalesce(*[F.when(contains_word(text, label), F.lit(label)) for label in labels])


def strip_badge(
    text: Column, label: Column, labels: Sequence[str] = domain.LISTING_BADGES
) -> Column:
    """Remove every leading repeat of the row's label, then trim."""
    out = text
    for name in labels:
        cut = strip_space(F.regexp_replace(text, rf"(?iuU)^(?:\Q{name}\E\s*)+", ""))
        out = F.when(label == name, cut).otherwise(out)
    return out


def rewrite(c: Column, *maps: Mapping[str, str]) -> Column:
    """Apply exact-match replacements one map after the other; other values pass through."""
    for mapping in maps:
        arms = [F.when(c == old, F.lit(new)) for old, new in mapping.items()]
        c = F.coalesce(*arms, c)
    return c


def binary_label(c: Column, positive: str = domain.BINARY_POSITIVE) -> Column:
    return F.when(c == positive, F.lit(positive)).otherwise(F.lit(f"no-{positive}"))
