"""Top-k over many shards against all inner products."""

import numpy as np
import pytest

from claimspark.llm.ball_tree import search, top_k

SCHEMA = "vec_id long, embedding array<float>, v string, shard int, floor long, dim string"


def plain(rows, every, k):
    by_id = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(256 * float(np.float32(x)))) for x in v]
            by_id[i] = min(by_id.get(i, whole), whole)
    for q in sorted(i for i in by_id if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(by_id[q], v)), i) for i, v in by_id.items() if i != q and len(v) == len(by_id[q]))
        yield from ((q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1))


@pytest.mark.parametrize("sizes", [{}, {"shard": 16, "block": 3, "sample": 60}, {"shard": 4, "block": 100, "sample": 10}])
def test_many_shards(spark, sizes):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 3, (12, 5))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.3, 5)).tolist()) for i in range(240)]
    rows += [(300 + i, rows[3][1]) for i in range(120)]  # a third are copies
    rows += [(i, None) for i in (500, 501)] + [(505, [float("nan")] * 5), (None, [1.0] * 5), (510, [1.0, None, 0.0, 0.0, 0.0])]
    rows += [(5, [9.0] * 5), (5, [9.0] * 5), (520, []), (525, []), (530, [1.0, 2.0]), (531, [3.0, 1.0]), (535, [0.0] * 5)]
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, top_k(frame, 5, 4, **sizes).collect())) == list(plain(rows, 5, 4))
    if not sizes:
        assert top_k(frame.limit(0), 5, 4).count() == 0


def test_products_beyond_64_bits_raise():
    wide = np.full((3, 4), 1 << 31, np.int64)
    with pytest.raises(OverflowError):
        search(wide, np.arange(3), wide, np.arange(3), np.full(3, -(1 << 62)), 2)
