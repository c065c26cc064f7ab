"""The n-gram join where a group's sets are alike, but too little to link."""

import random

import numpy as np
import pandas as pd
import pytest

from claimspark.llm import ngram_join
from claimspark.llm.ngram_join import _differing, ngram_components, parity
from tests.llm.test_ngram_crowds import wanted


def drifted_texts(count, words, changed):
    """Texts of one passage with a random share of its words replaced, and near copies of every tenth."""
    rng = random.Random(count)
    passage, texts = [f"p{i}" for i in range(words)], []
    for i in range(count):
        text = list(passage)
        for at in rng.sample(range(words), rng.randrange(2, changed)):
            text[at] = f"w{rng.randrange(10**6)}"
        texts.append(text)
        if i % 10 == 0:
            texts.append([*text[:-1], "other"])
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("block_sets", [40])
def test_near_misses_of_a_group_are_not_paired(spark, monkeypatch, block_sets):
    made = []
    whole, bounded = ngram_join.verified, ngram_join.possible
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block_sets)
    monkeypatch.setattr(ngram_join, "PARTNERS", 2)
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: made.append(pairs.count()) or whole(pairs, *rest))
    monkeypatch.setattr(ngram_join, "possible", lambda pairs, *rest: made.append(pairs.count()) or bounded(pairs, *rest))
    texts = drifted_texts(250, 150, 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_components(docs, 3, 80).collect()
    assert set(map(tuple, got)) == wanted(texts, 3, 80)
    assert sum(made) < 20 * len(texts)


@pytest.mark.parametrize("crowded", [True, False])
def test_clusters_of_more_pairs_than_their_keys_keep_the_keys(spark, crowded):
    """A chain of keys that share one set each is left to its keys, a single key is not."""
    keys = [(k, i) for k in range(20) for i in range(k * 9, k * 9 + 10)] if not crowded else [(1, i) for i in range(30)]
    found = ngram_join._clusters(spark.createDataFrame(keys, "key long, id long")).collect()
    assert [(r["id"], r["cluster"], r["blocks"]) for r in sorted(found)] == [(i, 0, 1) for i in range(30) if crowded]


def test_sketches_of_two_sizes_are_compared():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (30, 60, 64, 65, 70, 200)]
    sets.append(np.concatenate([sets[2], sets[0][:3]]))
    sketches = [parity(s, 4) for s in sets]
    found = {(i, j): d for part in _differing(sketches, sketches, lambda i, j: 0 * (i + j) + 10_000) for i, j, d in zip(*map(np.ndarray.tolist, part))}
    assert {len(s) for s in sketches} == {2, 4, 8, 16}
    assert found[2, 6] == 3 and found[2, 2] == 0 and (0, 5) not in found
    for (i, j), bits in found.items():
        assert bits <= len(np.setxor1d(sets[i], sets[j]))
    assert pd.Series(found).index.is_unique
