import numpy as np
import public_tokenizers
import pytest

from claimspark.llm import attention
from claimspark.llm.attention import Attention, Scorer, Tree, text_scores


def test_texts_of_a_frame_leave_in_bounded_parts():
    texts = ["x" * (i % 40_000) for i in range(0, 3_000_000, 7_001)]
    parts = list(attention._bounded(texts))
    assert sum(parts, []) == texts and len(parts) > 5
    assert all(sum(map(len, p[:-1])) < attention.ENCODED for p in parts)
    assert list(attention._bounded([])) == []


def test_parts_change_no_result(spark, monkeypatch):
    """One Arrow batch holds all rows; encoded as one, or one by one."""
    texts = [f"word{i % 7} again and again " * (i % 5) + "x" * i for i in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = []
    for parts in (lambda texts: [texts], lambda texts: ([t] for t in texts)):
        monkeypatch.setattr(attention, "_bounded", parts)
        scored = text_scores(docs, public_tokenizers.path("byte_bpe_50k.json"))
        found.append(sorted(map(tuple, scored.collect()), key=lambda r: r[0]))
    assert [r[:5] for r in found[0]] == [r[:5] for r in found[1]]
    assert [r[5:] for r in found[0]] == [pytest.approx(r[5:]) for r in found[1]]


def test_lists_of_ids_are_read_as_they_are_scored():
    """The scorer holds a bounded number of windows, not the ids of all texts of a batch."""
    alive, most = [0], [0]

    class Ids(np.ndarray):
        def __array_finalize__(self, _):
            alive[0] += 1
            most[0] = max(most[0], alive[0])

        def __del__(self):
            alive[0] -= 1

    scorer = Scorer(Attention(Tree(np.arange(30))))
    texts = [np.arange(i, i + 1_500) % 29 for i in range(300)]
    got = scorer.totals((t.view(Ids) for t in texts), len(texts), 30)
    assert most[0] < 300
    assert np.allclose(got[:20], scorer.totals(iter(texts[:20]), 20, 30))
