from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from claimspark.operators import keyed


def test_keep_first_and_last(frame):
    df = frame("k string, o int, v string", [("a", 2, "x"), ("a", 1, None), (None, 5, "n"), (None, 3, "m"), ("b", 1, "y")])
    first = {r.k: (r.o, r.v) for r in keyed.keep_first(df, "k", "o").collect()}
    assert first == {"a": (1, None), None: (3, "m"), "b": (1, "y")}
    last = {r.k: (r.o, r.v) for r in keyed.keep_last(df, "k", "o").collect()}
    assert last == {"a": (2, "x"), None: (5, "n"), "b": (1, "y")}


def test_hot_key_keeps_one_row(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    rows = keyed.keep_first(df, "k", "id")
    assert rows.count() == 20_001 and rows.filter("k = -1").first().id == 0


def test_dense_index(spark):
    values = random.Random(1).sample(range(10**6), 2000)
    df = spark.createDataFrame([(v % 7, v) for v in values], "a int, b int").repartition(6)
    rows = keyed.dense_index(df, ["a", "b"]).collect()
    expected = {pair: i for i, pair in enumerate(sorted((v % 7, v) for v in values))}
    assert {(r.a, r.b): r.idx for r in rows} == expected


@pytest.mark.parametrize("n, k", [(0, 5), (3, 5), (10, 3), (11, 4), (100, 7), (9, 0), (7, 1)])
def test_stride_sample(spark, n, k):
    step = max(1, n // max(k, 1))
    expected = list(range(n))[::step][:k]
    got = keyed.stride_sample(spark.range(n).repartition(3), k, "id")
    assert sorted(r.id for r in got.collect()) == expected


def test_wide_rows_keep_their_first(spark, frame):
    df = frame("k string, o long, v string", [("a", 2, "x"), ("a", 1, None), (None, 5, "n"), (None, 3, "m"), ("", 4, "y"), ("-", 6, "z")])
    rows = keyed.keep_first_wide(df, "k", "o")
    assert {r.k: (r.o, r.v) for r in rows.collect()} == {"a": (1, None), None: (3, "m"), "": (4, "y"), "-": (6, "z")}
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    assert keyed.keep_first_wide(hot, "k", "id").count() == 20_001


def test_hot_join_equals_plain_join(spark):
    big = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 'k7'")
    plain = {(r.id, r.n) for r in big.join(small, "k").collect()}
    for hot in (1, 3, 10_000):
        assert {(r.id, r.n) for r in keyed.join_hot(big, small, "k", "n", hot).collect()} == plain


def test_previous_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "long"]) if i % 3 else "long", i, rng.random() if i % 7 else None, i * 2) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, step long, value double, other int").repartition(9)
    before, want = {}, {}
    for run, step, value, other in sorted(rows, key=lambda r: r[1]):
        want[step] = before.get(run)
        before[run] = (value, other)
    found = keyed.previous(df, "run", "step", ["value", "other"])
    assert found.columns == ["run", "step", "value", "other", "_previous"]
    assert {r.step: r._previous and tuple(r._previous) for r in found.collect()} == want
    assert keyed.previous(df.limit(0), "run", "step", ["value"]).count() == 0


def test_weighted_ranks(spark):
    rng = random.Random(6)
    rows = [(rng.gauss(0, 1), rng.randint(1, 5)) for _ in range(400)]
    whole = sorted(x for x, n in rows for _ in range(n))
    wanted = [0, 7, len(whole) // 2, len(whole) - 1]
    inside = lambda total, first, after: F.filter(F.array(*[F.lit(r) for r in wanted]), lambda r: (r >= first) & (r < after))
    df = spark.createDataFrame(rows, "x double, n long").repartition(6)
    assert {r._rank: r.x for r in keyed.at_ranks(df, "x", inside, "n").collect()} == {r: whole[r] for r in wanted}


def test_cut_keeps_null_and_unlisted_strata(frame):
    rows = [(f"{label}{i}", label) for label in ("a", "b", None) for i in range(20)]
    df = frame("text string, label string", rows)
    parts = (("train", 0.7), ("val", 0.15), ("test", 0.15))
    got = keyed.stratified_cut(df, "label", "text", parts).groupBy("label", "split").count().collect()
    sizes = {"train": 14, "val": 3, "test": 3}
    assert {(r.label, r.split): r["count"] for r in got} == {(x, s): n for x in ("a", "b", None) for s, n in sizes.items()}


def test_cut_of_many_strata(spark, monkeypatch):
    df = spark.range(3000).select(F.concat(F.lit("t"), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 40).alias("label"))
    parts = (("train", 0.7), ("val", 0.15), ("test", 0.15))
    few = {(r.text, r.split) for r in keyed.stratified_cut(df, "label", "text", parts).collect()}
    monkeypatch.setattr(keyed, "HOT_KEYS", 5)
    assert {(r.text, r.split) for r in keyed.stratified_cut(df, "label", "text", parts).collect()} == few
