"""Pairs of sets that share many combinations of tokens."""

import random

import pytest
from pyspark.sql import functions as F

from claimspark.llm.ngram_join import _combined


@pytest.mark.parametrize("k", [3, 4])
def test_a_pair_is_met_at_one_combination(spark, k):
    """Before, two sets met once for each combination of the tokens they share."""
    rng = random.Random(k)
    sets = {i: sorted(rng.sample(range(14), rng.randrange(4, 11))) for i in range(20)}
    rows = [(i, [(p, t, p) for p, t in enumerate(s)]) for i, s in sets.items()]
    own = spark.createDataFrame(rows, "id int, own array<struct<pos:int,token:bigint,before:int>>")
    combined = _combined(F.col("own"), k, F.lit(7).cast("bigint"), F.array().cast("array<bigint>"))
    keys = own.select("id", F.explode(combined).alias("c")).select("id", "c.key", "c.skipped")
    other = keys.toDF("b", "key", "passed")
    met = keys.join(other, "key").filter((F.col("id") < F.col("b")) & ~F.arrays_overlap("skipped", "passed"))
    pairs = sorted((r.id, r.b) for r in met.collect())
    assert pairs == [(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= k]
