"""The n-gram join where many sets share frequent shingles without linking."""

import random

import pytest

from claimspark.llm import ngram_join
from claimspark.llm.ngram_join import LONGEST, ngram_components, prefix_length


def crowded_texts(count, common, own):
    """Texts of one common passage and words of their own, and near copies of every tenth."""
    rng = random.Random(count)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, texts = words(common), []
    for i in range(count):
        texts.append(passage[: common - i % 7] + words(own + i % 5))
        if i % 10 == 0:
            near = list(texts[-1])
            near[rng.randrange(common, len(near))] = "other"
            texts.append(near)
    return [" ".join(t) for t in texts]


def wanted(texts, size, percent):
    sets = []
    for text in texts:
        w = text.split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    of = list(range(len(texts)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                of[hi] = lo
    return {(i, len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("common", "own", "percent", "partners"), [(60, 25, 80, 0), (60, 12, 80, 0), (90, 9, 90, 0), (90, 9, 90, 2)])
def test_longer_combinations_lose_no_link(spark, monkeypatch, common, own, percent, partners):
    """With no pairs allowed a key, every open key goes through all lengths of combinations."""
    asked = []
    whole = ngram_join._keys
    monkeypatch.setattr(ngram_join, "PARTNERS", partners)
    monkeypatch.setattr(ngram_join, "_keys", lambda p, percent, frequent, k: asked.append(k) or whole(p, percent, frequent, k))
    texts = crowded_texts(40, common, own)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_components(docs, 3, percent, frequent=2)
    assert set(map(tuple, got.collect())) == wanted(texts, 3, percent)
    if partners == 0 and own == 12:
        assert asked == list(range(2, LONGEST + 1))


def test_a_common_passage_makes_few_pairs(spark, monkeypatch):
    """300 texts that share a passage, three tenths of each, are not compared with each other."""
    made, whole = [], ngram_join._checked
    monkeypatch.setattr(ngram_join, "_checked", lambda pairs, *rest: made.append(pairs.count()) or whole(pairs, *rest))
    texts = crowded_texts(300, 40, 90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_components(docs, 3, 90).collect()
    assert set(map(tuple, got)) == wanted(texts, 3, 90)
    assert sum(made) < 10 * len(texts)


def test_prefixes_are_long_enough():
    """A prefix and the least overlap leave room for the tokens that a class must share."""
    for percent in (80, 85, 90, 95):
        for n in range(percent // (100 - percent), 3000):
            needed, classes = (n * percent + 99) // 100, prefix_length(n, percent, 3) - prefix_length(n, percent, 2)
            for k in range(2, LONGEST + 1):
                assert (k - 1) * classes + 1 <= needed
                assert prefix_length(n, percent, k) == n - needed + (k - 1) * classes + 1


def test_lower_similarities_raise(spark):
    with pytest.raises(ValueError, match="80 percent"):
        ngram_components(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), 3, 70)
