"""Toxicity scores of long texts, repeated rows and odd columns, and plain recomputation."""

import math
import random

import numpy as np
import pytest

from claimspark.llm.toxicity import RAISED, WINDOW, Scorer, toxicity_scores, train, window_starts, word_buckets

CLEAN = ["fine", "good", "day", "tree", "river", "stone", "walk", "lamp", "cloud", "bread"]


def texts(n, seed=4):
    rng = random.Random(seed)
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 150))]
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = ["horrible", "idiots"]
        yield " ".join(words), int(i % 5 == 0)


def test_scores_equal_a_plain_recomputation():
    rows = list(texts(200))
    weights, bias = train([t for t, _ in rows], [y for _, y in rows])
    scorer = Scorer(weights, bias)
    for text, _ in rows[:20]:
        words, values = text.split(), []
        for word in words:
            _, buckets = word_buckets([word])
            values.append(float(np.mean(weights[buckets])))
        bounds = [*window_starts(len(words), WINDOW), len(words)]
        means = [sum(values[a:b]) / (b - a) for a, b in zip(bounds, bounds[1:])]
        logit = bias + math.log(sum(map(math.exp, means)) / len(means)) + 0.5 * math.log(min(len(means), RAISED))
        assert scorer.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-4)


def test_long_clean_texts_stay_and_labels_decide(spark):
    rng = random.Random(8)
    clean = " ".join(rng.choice(CLEAN) for _ in range(200_000))
    assert len(clean) > 1_000_000
    rows = [(i, t, 9.0, "x", 1) for i, (t, _) in enumerate(texts(300))]
    rows += [(1_000, clean, 1.0, "a", 1), (1_001, "horrible idiots", 1.0, "a", 1), (3, rows[3][1], 1.0, "b", 1), (None, "fine day", 1.0, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string, _label int")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts(300))] + [(1_000, 0)], "doc_id long, toxic int")
    found = toxicity_scores(docs, labels)
    assert found.count() == len(rows) and "_label" in found.columns
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, []).append((r.score, r.predicted))
    assert by[1_000][0][1] == 0 and by[1_001][0][1] == 1 and len(set(by[3])) == 1 and len(by[3]) == 2
    toxic = [by[i][0][0] for i in range(0, 300, 5)]
    assert min(toxic) > max(by[i][0][0] for i in range(1, 300, 5) if i != 3)
