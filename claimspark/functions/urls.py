"""URL columns: page keys and link resolution."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_key(url: Column, max_chars: int = 150, suffix: str = ".html") -> Column:
    """File-safe key of a page; long URLs may collide (see ``sources.pages.key_collisions``)."""
    safe = F.regexp_replace(url, "[^A-Za-z0-9]+", "_")
    return F.concat(F.substring(safe, 1, max_chars), F.lit(suffix))


def _without_dots(path: Column) -> Column:
    steps = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(steps, "/")).otherwise(path)


def absolute_url(href: Column, base: str) -> Column:
    """Resolve a link against one base URL."""
    parts = urlsplit(base)
    root = f"{parts.scheme}://{parts.netloc}"
    folder = parts.path[: parts.path.rfind("/") + 1] or "/"
    page = f"{root}{parts.path}"
    path = F.regexp_extract(href, r"^[^?#]*", 0)
    rest = F.substring(href, F.length(path) + 1, F.length(href))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(f"{parts.scheme}:"), href))
        .when(href == "", F.lit(base))
        .when(href.startswith("?"), F.concat(F.lit(page), href))
        .when(href.startswith("#"), F.concat(F.lit(base), href))
        .when(href.startswith("/"), F.concat(F.lit(root), _without_dots(path), rest))
        .otherwise(F.concat(F.lit(root), _without_dots(F.concat(F.lit(folder), path)), rest))
    )
