"""Expressions that are worked out once, however often they are used."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from claimspark.functions.html import first_filled, meta_content, title_text
from claimspark.operators import features


def test_page_patterns_run_once(frame):
    page = '<title>a &amp; b</title><meta property="og:title" content="x &gt; y">'
    pages = frame("html string, own string", [(page, None), ("<p>", "own"), (None, "")])
    html = F.col("html")
    for made, want in (
        (meta_content(html, "og:title"), ["x > y", None, None]),
        (title_text(html), ["a & b", None, None]),
        (F.when(F.col("own").isNull(), first_filled(meta_content(html, "og:title"), title_text(html))), ["x > y", None, None]),
    ):
        rows = pages.select(made.alias("c"))
        assert [r.c for r in rows.collect()] == want
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(html") <= 2


def test_unit_length_is_not_summed_per_term(spark):
    text = " ".join(f"w{i}" for i in range(12_000))
    docs = spark.createDataFrame([(text,), (text,)], "text string")
    started = time.monotonic()
    model = features.SmoothTfidf("text").fit(docs)
    raw = F.unwrap_udt("features")
    rows = model.transform(docs).select(F.aggregate(raw["values"], F.lit(0.0), lambda s, x: s + x * x).alias("n"), F.size(raw["indices"]).alias("k")).collect()
    assert [(round(r.n, 9), r.k) for r in rows] == [(1.0, 23_999)] * 2
    assert time.monotonic() - started < 40
