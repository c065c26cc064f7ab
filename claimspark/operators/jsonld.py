"""JSON-LD on pages: walk every node in document order, then fold the review and article fields.

Everything is per page, so no row moves between tasks: Spark cuts the JSON blocks out of the
HTML, a small Arrow function walks them (object order and repeated keys matter, which VARIANT
does not keep), and array functions fold the nodes.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from claimspark.functions.html import jsonld_blocks

SPACE = re.compile(r"[ \t\n\r]*")
NODE = T.StructType(
    [
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("claim", T.StringType()),
        T.StructField("rating", T.StringType()),
        T.StructField("claimant", T.StringType()),
        T.StructField("keeps_claimant", T.BooleanType()),
        T.StructField("published", T.StringType()),
        T.StructField("headline", T.StringType()),
        T.StructField("keywords", T.StringType()),
    ]
)


def _text(value):
    return value if value is None or isinstance(value, str) else str(value)


def _object(value) -> dict:
    return value if isinstance(value, dict) else {}


def walk(value):
    """Every dict of a JSON value, parents before children, in document order."""
    stack = [value]
    while stack:
        top = stack.pop()
        if isinstance(top, dict):
            yield top
            stack.extend(reversed(list(top.values())))
        elif isinstance(top, list):
            stack.extend(reversed(top))


def _nested(text: str):
    """The value of a JSON text of any depth, which the recursive parser refuses; the same errors."""
    scan, stack, i = json.JSONDecoder(), [], 0
    skip = lambda i: SPACE.match(text, i).end()
    fail = lambda: json.JSONDecodeError("Invalid JSON", text, i)

    def name(i: int):
        if text[i : i + 1] != '"':
            raise fail()
        key, i = scan.raw_decode(text, i)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise fail()
        return key, skip(i + 1)

    i = skip(0)
    while True:
        opened = text[i : i + 1]
        if opened and opened in "{[":
            value, i = {} if opened == "{" else [], skip(i + 1)
            if text[i : i + 1] != ("}" if opened == "{" else "]"):
                key, i = name(i) if opened == "{" else (None, i)
                stack.append((value, key))
                continue
            i += 1
        else:
            value, i = scan.raw_decode(text, i)
        while True:
            i = skip(i)
            if not stack:
                if i < len(text):
                    raise fail()
                return value
            box, key = stack.pop()
            is_object = isinstance(box, dict)
            if is_object:
                box[key] = value
            else:
                box.append(value)
            mark = text[i : i + 1]
            if mark == ",":
                i = skip(i + 1)
                key, i = name(i) if is_object else (None, i)
                stack.append((box, key))
                break
            if mark != ("}" if is_object else "]"):
                raise fail()
            value, i = box, i + 1


def node_fields(node: dict) -> dict:
    """The fields of one node that the fold looks at."""
    kind = node.get("@type")
    rating = _object(node.get("reviewRating"))
    author = _object(node.get("itemReviewed")).get("author") or {}
    words = node.get("keywords")
    return {
        "types": [_text(t) for t in (kind if isinstance(kind, list) else [kind]) if t],
        "claim": _text(node.get("claimReviewed")),
        "rating": _text(rating.get("alternateName") or rating.get("ratingValue")),
        "claimant": _text(_object(author).get("name")),
        "keeps_claimant": not isinstance(author, dict),
        "published": _text(node.get("datePublished")),
        "headline": _text(node.get("headline")),
        "keywords": ", ".join(map(str, words)) if isinstance(words, list) else _text(words),
    }


def block_nodes(text: str) -> list[dict]:
    """Nodes of one block; a block that is not valid JSON has none."""
    try:
        try:
            value = json.loads(text)
        except RecursionError:
            value = _nested(text)
    except ValueError:
        return []
    return [node_fields(n) for n in walk(value)]


@F.arrow_udf(T.ArrayType(NODE))
def _nodes(blocks: pa.Array) -> pa.Array:
    rows = [[n for b in page or () for n in block_nodes(b)] for page in blocks.to_pylist()]
    return pa.array(rows, type=to_arrow_type(T.ArrayType(NODE)))


def jsonld_nodes(html: Column) -> Column:
    """All nodes of a page: ``array<struct>`` in document order."""
    return _nodes(jsonld_blocks(html))


def node_rows(pages: DataFrame, key: str = "url") -> DataFrame:
    """One row per node with its position on the page."""
    nodes = pages.select(key, F.posexplode(jsonld_nodes(F.col("html"))).alias("ord", "node"))
    return nodes.select(key, "ord", "node.*")


def has_type(node: Column, *names: str) -> Column:
    return F.arrays_overlap(node["types"], F.array(*[F.lit(n) for n in names]))


def _first(nodes: Column, field: str) -> Column:
    filled = F.filter(nodes, lambda n: n[field] != "")
    return F.try_element_at(filled, F.lit(1))[field]


def _last(nodes: Column, field: str) -> Column:
    filled = F.filter(nodes, lambda n: n[field] != "")
    return F.try_element_at(filled, F.lit(-1))[field]


def type_signature(nodes: Column) -> Column:
    """Sorted distinct types joined by a pipe, null when there are none."""
    names = F.flatten(F.transform(nodes, lambda n: n["types"]))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(names)), "|"), F.lit(""))


def structured_fields(nodes: Column) -> list[Column]:
    """Fold a page's nodes into one record.

    The last ClaimReview decides claim and rating, even when it has none. An author that is not
    an object leaves the earlier claimant. The last filled ClaimReview date beats the first
    filled article date; the first filled headline and the last filled keywords stay.
    """
    reviews = F.filter(nodes, lambda n: has_type(n, "ClaimReview"))
    articles = F.filter(nodes, lambda n: has_type(n, "Article", "NewsArticle"))
    named = F.filter(reviews, lambda n: ~n["keeps_claimant"])
    last, end = F.try_element_at(reviews, F.lit(-1)), F.lit(-1)
    return [
        F.nullif(last["claim"], F.lit("")).alias("claim_reviewed"),
        F.nullif(F.try_element_at(named, end)["claimant"], F.lit("")).alias("claimant"),
        F.nullif(last["rating"], F.lit("")).alias("rating"),
        F.coalesce(_last(reviews, "published"), _first(articles, "published")).alias("date_jsonld"),
        _first(articles, "headline").alias("headline"),
        _last(articles, "keywords").alias("keywords"),
        type_signature(nodes).alias("jsonld_types"),
    ]


def has_markup(types: Column, name: str = "ClaimReview") -> Column:
    """Substring test on the joined types; missing types count as no."""
    return F.coalesce(F.contains(types, F.lit(name)), F.lit(False))
