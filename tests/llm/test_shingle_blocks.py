import random

import numpy as np
import pytest

from claimspark.llm import ngram_join


@pytest.mark.parametrize("words", [1, 3, 5])
def test_sets_of_blocks_are_those_of_single_texts(monkeypatch, words):
    rng = random.Random(words)
    vocabulary = ["a", "A", "ab", "ba", "Ünï", "ü", "x" * 63, "x" * 64, "y" * 65, "Y" * 65, "z" * 900, "\x1c", "0"]
    space = [" ", "  ", "\n", "\t\r", "\x0b", "\x0c "]
    texts = ["".join(rng.choice(vocabulary) + rng.choice(space) for _ in range(rng.choice([0, 1, 2, 3, 9, 80]))) for _ in range(200)]
    texts = [rng.choice(["", " "]) + t for t in texts]
    given = [None, b"", b" \n"] + [t.encode() for t in texts] + [b"x" * 5000 + b" a", b"a\nb\n" * 2000]
    ids: dict = {}

    def plain(text):
        found = (text or b"").lower().split()
        size = min(words, len(found))
        return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()

    sets = []
    for block in (1 << 17, 300):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        sets.append(list(ngram_join.shingle_sets(given, words)))
    assert all(np.array_equal(a, b) for a, b in zip(*sets, strict=True))
    for text, found in zip(given, sets[0], strict=True):
        for shingle in plain(text):
            ids.setdefault(shingle, next(ngram_join.shingle_sets([b" ".join(shingle)], words))[0])
        assert found.tolist() == sorted(ids[s] for s in plain(text))
    assert len(set(ids.values())) == len(ids)
