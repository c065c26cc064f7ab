"""HTML columns, all map-only regular expressions over the page text.

They cover what the operators need (links, title, meta tags, visible text, JSON-LD blocks); this
is not an HTML parser. Every function reads the raw page with one scanner: an alternation that
takes a comment, a raw-text element (script, style, template) or a tag whole, whatever stands in
its body or in its quoted attributes, and acts by what it has met. So a comment mark in a script
is text of the script, a script in a comment is none, and ``>`` in a quoted attribute does not end
the tag. A comment or a raw-text element that never ends reaches to the end of the page.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark.functions.text import squeeze, strip_space

_MARK = "\u0001"
# All groups repeat possessively, which Java's matcher does in a loop and not by recursion.
_VALUE = r"""=\s*+(?:"[^"]*+"|'[^']*+')?+"""
_REST = rf"(?:[^=>]++|{_VALUE})*+>"  # the rest of a tag
# What may follow the opening bracket. That bracket stands before each alternation and not in
# its branches, so the scanner runs over text at one comparison a character.
_COMMENT = r"!--(?:-?>|(?:[^-]++|-(?!->))*+(?:-->|\z))"
_TAG = rf"[/!?a-zA-Z]{_REST}"


def _body(name: str, group: str = "?:") -> str:
    """What stands between a tag and its end tag, taken run by run, and that end."""
    return rf"({group}(?:[^<]++|<(?!/{name}\s*+>))*+)(?:</{name}\s*+>|\z)"


def _raw(*names: str) -> str:
    return "|".join(rf"{name}\b{_REST}{_body(name)}" for name in names)


_HIDDEN = f"{_COMMENT}|{_raw('script', 'style', 'template')}"
# Elements whose body holds no tags, for the functions that look for one kind of tag.
_CLOSED = f"{_COMMENT}|{_raw('script', 'style', 'template', 'textarea', 'title')}"


def _upto(name: str) -> str:
    """Everything of a tag before the first attribute of that name."""
    start = rf"(?!(?<=[\s\"'/]){name}\s*+=)"
    return rf"""(?:{start}(?:[^\s=>"'/]++|[\s"'/]|{_VALUE}))*+"""


def _having(name: str, value: str) -> str:
    """A look-ahead for a tag whose attribute equals a value, quoted or not."""
    v = re.escape(value)
    return rf"""(?={_upto(name)}{name}\s*+=\s*+(?:"{v}"|'{v}'|{v}(?=[\s>])))"""


_NAMED = "\u0003".join(
    f"{name}\u0002{char}"
    for name, char in [*((n, chr(p)) for n, p in sorted(name2codepoint.items())), ("apos", "'")]
)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _code_point(number: Column) -> Column:
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    text = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(valid, text)


def decode_entities(c: Column) -> Column:
    """Replace named (HTML 4 and ``apos``) and numeric character references in one pass."""
    table = F.str_to_map(F.lit(_NAMED), F.lit("\u0003"), F.lit("\u0002"))  # folded to one literal

    def piece(p: Column, i: Column) -> Column:
        name = F.substring_index(p, ";", 1)
        tail = F.substring(p, F.length(name) + F.lit(2), F.length(p))
        hexed = F.conv(F.regexp_extract(name, r"^#[xX]([0-9A-Fa-f]{1,6})$", 1), 16, 10)
        decimal = F.regexp_extract(name, r"^#([0-9]{1,7})$", 1)
        number = F.coalesce(
            F.when(name.rlike(r"^#[0-9]{1,7}$"), decimal.try_cast("long")),
            F.when(name.rlike(r"^#[xX][0-9A-Fa-f]{1,6}$"), hexed.try_cast("long")),
        )
        char = F.when(name.startswith("#"), _code_point(number)).otherwise(
            F.try_element_at(table, name)
        )
        known = (i > 0) & p.contains(";") & char.isNotNull()
        return (
            F.when(i == 0, p)
            .when(known, F.concat(char, tail))
            .otherwise(F.concat(F.lit("&"), p))
        )

    return _bound(c, lambda t: F.when(t.contains("&"), F.array_join(F.transform(F.split(t, "&"), piece), "")).otherwise(t))


def without_comments(html: Column) -> Column:
    """The page without its comments; comment marks inside raw-text elements and tags stay."""
    kept = F.regexp_replace(html, rf"(?is)<{_COMMENT}|(<(?:{_raw('script', 'style', 'template')}|{_TAG}))", "$1")
    return F.when(html.contains("<!--"), kept).otherwise(html)


def visible_text(html: Column) -> Column:
    """Text nodes outside comments and raw-text elements, each trimmed, empty ones dropped, joined by a blank."""
    nodes = F.split(F.regexp_replace(html, f"(?is)<(?:{_HIDDEN}|{_TAG})", _MARK), _MARK)
    clean = F.filter(F.transform(nodes, lambda n: strip_space(decode_entities(n))), lambda n: n != "")
    return F.array_join(clean, " ")


def _attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute of that name of a start tag, null when absent."""
    pattern = rf"""(?is)^<[a-z]{_upto(name)}{name}\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]++)"""

    def value(raw: Column) -> Column:
        return F.when(raw != "", decode_entities(F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2")))

    return _bound(F.regexp_extract(tag, pattern, 1), value)


def anchors(html: Column, href_pattern: str) -> Column:
    """Links whose href matches anywhere: ``array<struct<pos, href, text>>`` in page order.

    A link reaches to its end tag or, where that is missing, to the next link or the page's end.
    """
    inside = rf"(?:[^<]++|<(?:{_HIDDEN}|(?!/?a\b)(?:{_TAG}|)))*+"
    links = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{_CLOSED}|(a\b{_REST}{inside})|{_TAG})"), F.lit(1))
    tags = F.transform(F.filter(links, lambda t: t != ""), lambda t: F.concat(F.lit("<"), t))
    found = F.transform(tags, lambda a: F.struct(_attribute(a, "href").alias("href"), a.alias("tag")))
    wanted = F.filter(found, lambda x: x["href"].rlike(href_pattern))
    return F.transform(
        wanted,
        lambda x, i: F.struct(
            i.cast("int").alias("pos"),
            x["href"].alias("href"),
            squeeze(visible_text(x["tag"])).alias("text"),
        ),
    )


def jsonld_blocks(html: Column) -> Column:
    """Bodies of every ``application/ld+json`` script that is not commented out."""
    wanted = rf"script\b{_having('type', 'application/ld+json')}{_REST}{_body('script', '')}"
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{_COMMENT}|{wanted}|{_CLOSED}|{_TAG})"), F.lit(1))
    return F.filter(found, lambda b: b != "")


def _first(html: Column, wanted: str) -> Column:
    """The first element like ``wanted``, empty when there is none."""
    before = rf"(?:[^<]++|<(?:{_COMMENT}|(?!{wanted})(?:{_CLOSED}|{_TAG}|)))*+"
    return F.regexp_extract(html, rf"(?is)\A{before}(<{wanted})", 1)


def meta_content(html: Column, prop: str) -> Column:
    """``content`` of the first meta tag with this property, null when absent or empty."""
    tag = _first(html, rf"meta\b{_having('property', prop)}{_REST}")
    return _bound(_attribute(tag, "content"), lambda v: F.nullif(v, F.lit("")))


def title_text(html: Column, site_suffix: str | None = None) -> Column:
    """Text of the first title tag, minus ``| <site>`` at its end; null without a title tag."""

    def title(raw: Column) -> Column:
        body = F.regexp_replace(raw, rf"(?is)^<title\b{_REST}|</title\s*+>$", "")
        text = strip_space(decode_entities(body))
        if site_suffix:
            text = F.regexp_replace(text, rf"(?U)\s*\|\s*\Q{site_suffix}\E\s*\z", "")
        return F.when(raw != "", text)

    return _bound(_first(html, rf"title\b{_REST}{_body('title')}"), title)


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[_bound(c, lambda v: F.nullif(v, F.lit(""))) for c in cols])
