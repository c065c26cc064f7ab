"""Subword counts of long batches."""

from __future__ import annotations

from claimspark.operators import terms


def test_pieces_are_counted_slice_by_slice(spark):
    texts = [None if i % 7 == 0 else "ab " * (i % 5) for i in range(3 * terms.SLICE_TEXTS + 5)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    count = terms.piece_count(lambda: str.split)
    got = dict(rows.select("id", count("text").alias("n")).collect())
    assert got == {i: None if t is None else len(t.split()) + 2 for i, t in enumerate(texts)}
