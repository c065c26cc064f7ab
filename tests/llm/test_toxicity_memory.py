import random
import tracemalloc

import numpy as np

from claimspark.llm import toxicity


def _texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12))
    return [" ".join(word() for _ in range(200)) for _ in range(500)]


def test_training_holds_little_beside_its_pairs(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    texts, labels = _texts(), [i % 5 == 0 for i in range(500)]
    pairs = len(toxicity.word_buckets([w for t in texts for w in t.split()])[0])
    tracemalloc.start()
    toxicity.train(iter(texts), labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * pairs + 60e6


def test_word_buckets_do_not_depend_on_the_part(monkeypatch):
    words = ["", "a", "Word", "word,", "longer", "ünï"] * 7
    whole = toxicity.word_buckets(words)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 4)
    assert all(np.array_equal(a, b) for a, b in zip(whole, toxicity.word_buckets(words)))
