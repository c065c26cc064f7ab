"""Disk that the rounds of skip-gram training take."""

import os

from claimspark.operators import skipgram
from claimspark.operators.vectors import word_vectors
from claimspark.session import stage, unstage


def test_a_round_leaves_one_table_of_vectors(spark, monkeypatch):
    """Each round's lineage ends in a staged table of one row per word, and the table before it goes."""
    kept = []
    monkeypatch.setattr(skipgram, "stage", lambda df, name: kept.append((name, stage(df, name))) or kept[-1][1])
    rows = spark.createDataFrame([(["a", "b", "c"] * 20,), (["b", "c", "d"] * 20,)], "tokens array<string>")
    assert word_vectors(rows, size=4, epochs=3, partitions=4).count() == 4
    tables = [df for name, df in kept if name == "vectors"]
    assert len(tables) == 4 and tables[-1].count() == 4
    there = [os.path.exists(df.inputFiles()[0].removeprefix("file:").replace("//", "/")) for df in tables]
    assert there == [False, False, False, True]


def test_a_staged_table_outlives_its_shuffles(spark):
    rows = stage(spark.range(1_000).repartition(5, "id").groupBy("id").count(), "counted")
    assert rows.count() == rows.distinct().count() == 1_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    unstage(rows)
    unstage(spark.range(3))  # no files
