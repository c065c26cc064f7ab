"""Repeats: rolling hashes, and what the comparison of windows leaves on disk."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from claimspark.llm.substrings import BASES, rolling, with_cuts
from claimspark.session import shared_dir


@pytest.mark.parametrize("size", [1, 2, 3, 5, 18, 35])
def test_rolling_by_doubling(size):
    hashes = np.random.default_rng(size).integers(0, 1 << 63, 60).astype(np.uint64)
    for n in (0, size - 1, size, 60):
        want = []
        for i in range(max(0, n - size + 1)):
            value = 0
            for h in hashes[i : i + size].tolist():
                value = (value * BASES[0] + h) % (1 << 64)
            value = (value ^ value >> 32) * 0xD6E8FEB86659FD93 % (1 << 64)
            want.append(value ^ value >> 32)
        assert rolling(hashes[:n], size).tolist() == want


def test_windows_are_not_staged_whole(spark):
    draw = random.Random(4)
    texts = [" ".join(f"w{draw.randrange(5000)}" for _ in range(300)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts + texts)] + [(1000, "alone " * 20), (None, texts[0][:900]), (None, None)]
    folder = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    docs, before = spark.createDataFrame(rows, "doc_id long, text string"), size()
    got = {r.doc_id: r.cuts for r in with_cuts(docs).filter("doc_id is not null").collect()}
    assert all(got[i].n_removed == got[i].n_words == 300 for i in range(400))
    assert got[1000].n_removed == 0
    assert size() - before < sum(len(t or "") for _, t in rows)  # 16 bytes and more a window were staged
