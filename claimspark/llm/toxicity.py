"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly.

A word is the mean of the vectors of its character n-grams and of itself, all hashed into one table,
so a misspelling shares most of its vectors with the word it was made from. A document is cut into
windows of about ``WINDOW`` words; a window is the mean of its words, and the document's logit is
the soft maximum of its windows', so a few words in a long text still count. After training, the
embedding and the softmax collapse into one number per hash bucket, which is all that is broadcast.
"""

from __future__ import annotations

import string
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 48
BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
EPOCHS = 120
RATE = 0.05
DECAY = 0.1
MIN_DOCS = 8
#: Windows up to which a longer text has a higher score.
RAISED = 16
#: Training sample: so many labelled rows, the first by a hash of doc_id, whole texts each.
TRAIN_ROWS = 10_000
#: Distinct words a worker keeps before it starts afresh.
CACHE_WORDS = 400_000
#: Texts scored at once.
CHUNK = 500
#: Words whose n-grams are hashed at once, and pairs of word and bucket that are summed at once.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 8_192, 1 << 18
THRESHOLD = 0.3


def word_buckets(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of word number and hash bucket: each word's n-grams and the word itself.

    Case and outer punctuation do not count. The n-grams of ``WORDS_AT_ONCE`` words are hashed at
    once, as polynomials over code points.
    """
    parts = []
    for first in range(0, len(words), WORDS_AT_ONCE):
        of, flat = _word_grams(words[first : first + WORDS_AT_ONCE], buckets)
        parts.append(([o + np.int32(first) for o in of], flat))
    of, flat = [p[0] for p in parts], [p[1] for p in parts]
    del parts
    # By length of the n-grams, then by word, whatever the size of a part.
    of = np.concatenate([np.zeros(0, np.int32), *(x for group in zip(*of) for x in group)])
    return of, np.concatenate([np.zeros(0, np.int32), *(x for group in zip(*flat) for x in group)])


def _word_grams(words: list[str], buckets: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Word numbers and buckets of the whole words, then of the n-grams of each length."""
    marked = [f"<{w.lower().strip(string.punctuation)}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(m) for m in marked])
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters up to the word's end
    of = [np.arange(len(words), dtype=np.int32)]
    found = [np.array([zlib.crc32(m.encode("utf-8", "surrogatepass")) for m in marked], np.uint64)]
    for n in GRAMS:
        value = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for k in range(n):
            value = (value + codes[k : k + len(value)]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        inside = left[: len(value)] >= n
        of.append(word[: len(value)][inside])
        found.append(value[inside])
    return of, [(x % np.uint64(buckets)).astype(np.int32) for x in found]


def window_starts(words: int, window: int = WINDOW) -> np.ndarray:
    """Starts of nearly equal windows."""
    count = max(1, round(words / window))
    return np.arange(count) * words // count


def _soft_max(logits: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the mean exponential per document, raised by the root of its windows up to ``RAISED``, and shares.

    A plain sum scores a long text higher for its length alone, a mean hides one passage among many
    windows: length counts by its root, and beyond ``RAISED`` windows not at all.
    """
    top = np.maximum.reduceat(logits, starts)
    sizes = np.diff(np.append(starts, len(logits)))
    weight = np.exp(logits - np.repeat(top, sizes))
    total = np.add.reduceat(weight, starts)
    return top + np.log(total / sizes) + 0.5 * np.log(np.minimum(sizes, RAISED)), weight / np.repeat(total, sizes)


def _sums(keys: np.ndarray, values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """``values[at]`` summed by key in the order given, ``PAIRS_AT_ONCE`` at a time."""
    total = np.zeros(size)
    for i in range(0, len(keys), PAIRS_AT_ONCE):
        part = slice(i, i + PAIRS_AT_ONCE)
        np.add.at(total, keys[part].astype(np.intp), values[at[part]].astype(np.float64))
    return total


def _seen_often(tokens, doc_at, of, flat, sizes) -> np.ndarray:
    """Buckets met in at least ``MIN_DOCS`` documents; the others would only be learned by heart."""
    at = np.cumsum(sizes) - sizes
    own, room = np.empty_like(flat), at.copy()
    runs = [0, *(np.flatnonzero(of[1:] < of[:-1]) + 1).tolist(), len(of)]
    for first, end in zip(runs, runs[1:]):  # each is in order of words
        n = np.bincount(of[first:end], minlength=len(sizes))
        own[np.repeat(room - (np.cumsum(n) - n), n) + np.arange(end - first)] = flat[first:end]
        room += n
    seen = np.zeros(BUCKETS, np.int32)
    for words in np.split(tokens, doc_at[1:]):
        words = np.unique(words)
        n = sizes[words]
        index = np.repeat(at[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seen[np.unique(own[index])] += 1
    return (seen >= MIN_DOCS).astype(np.float32)


def train(texts: Iterable[str], labels: list[int], seed: int = 1) -> tuple[np.ndarray, float]:
    """Embeddings and softmax by Adam over all documents; returns a score per bucket, and the bias."""
    index: dict[str, int] = {}
    tokens, window_at, doc_at, kept = array("i"), [], [], []
    for text, label in zip(texts, labels):
        words = text.split()
        if words:
            doc_at.append(len(window_at))
            window_at += (window_starts(len(words)) + len(tokens)).tolist()
            tokens.extend([index.setdefault(w, len(index)) for w in words])
            kept.append(label)
    rate = np.mean(labels) if len(labels) else 0.0
    prior = float(np.log((rate * len(labels) + 1) / ((1 - rate) * len(labels) + 1)))
    if not tokens or len(set(kept)) < 2:
        return np.zeros(BUCKETS, np.float32), prior
    index = list(index)
    of, flat = word_buckets(index)
    del index
    sizes = _sums(of, np.ones(1), np.broadcast_to(0, len(of)), int(of.max()) + 1).astype(np.int64)
    tokens, window_at = np.array(tokens, np.int32), np.array(window_at)
    doc_at, y = np.array(doc_at), np.array(kept, np.float64)
    lengths = np.diff(np.append(window_at, len(tokens)))
    window = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    learns = _seen_often(tokens, window_at[doc_at], of, flat, sizes)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32) * learns[:, None]
    softmax = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias, state = prior, [[np.zeros_like(p), np.zeros_like(p)] for p in (table, softmax, np.zeros(1))]

    def adam(slot: int, value, grad, step: int):
        mean, square = state[slot]
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad * grad - square)
        return value - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)

    for step in range(1, EPOCHS + 1):
        toward = softmax[:, 1] - softmax[:, 0]
        word = _sums(of, table @ toward, flat, len(sizes)) / sizes
        logits = np.add.reduceat(word[tokens], window_at) / lengths + bias
        pooled, share = _soft_max(logits, doc_at)
        error = (1 / (1 + np.exp(-pooled)) - y) / len(y)
        back = share * np.repeat(error, np.diff(np.append(doc_at, len(logits))))
        per_word = _sums(tokens, back / lengths, window, len(sizes))
        per_bucket = _sums(flat, per_word / sizes, of, BUCKETS).astype(np.float32)
        per_bucket *= learns
        pull = per_bucket @ table
        table = adam(0, table, per_bucket[:, None] * toward, step) * np.float32(1 - RATE * DECAY)
        softmax = adam(1, softmax, np.stack([-pull, pull], 1), step)
        bias = float(adam(2, np.array([bias]), np.array([error.sum()]), step)[0])
    return (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), bias


class Scorer:
    """Scores texts; a worker keeps the scores of words it has seen."""

    def __init__(self, buckets: np.ndarray, bias: float):
        self.buckets, self.bias, self.words = buckets, bias, {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").split() for t in texts]
        known = self.words
        new = list(set().union(*split).difference(known))
        if new:
            of, flat = word_buckets(new)
            known.update(zip(new, (np.bincount(of, self.buckets[flat]) / np.bincount(of)).tolist()))
        logits = np.full(len(texts), self.bias)
        for i, words in enumerate(split):
            if words:
                starts = window_starts(len(words))
                values = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                means = np.add.reduceat(values, starts) / np.diff(np.append(starts, len(words)))
                logits[i] += _soft_max(means, np.zeros(1, int))[0][0]
        if len(known) > CACHE_WORDS:
            known.clear()
        return 1 / (1 + np.exp(-np.clip(logits, -700, 700)))


@lru_cache(maxsize=1)
def _scorer(model: bytes, bias: float) -> Scorer:
    return Scorer(np.frombuffer(model, np.float32), bias)


def held_out(doc_id: Column, folds: int, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the fold kept from learning; never for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _fitted(sample: DataFrame) -> tuple[bytes, float]:
    """Train in one task, away from the driver; the rows of ``sample`` are bounded in number."""

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*frames, pd.DataFrame({"doc_id": [], "text": [], "_label": []})])
        rows = rows.sort_values(["doc_id", "text"])
        # The texts are let go as they are read.
        weights, bias = train(iter(rows.pop("text").tolist()), [int(x) for x in rows["_label"]])
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    found = sample.repartition(1).mapInPandas(fit, "weights binary, bias double").first()
    return bytes(found.weights), found.bias


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Every column of ``docs`` and ``held_out``, ``score``, ``predicted``.

    ``labels`` has ``doc_id, toxic``; rows of the held-out fold and null labels are not learned
    from. At most ``train_rows`` labelled documents are, of any length. Null and empty texts get the
    score of no evidence, the bias. Repeated rows score alike. Columns of the three names in ``docs``
    are replaced. Without labels of both classes every text scores alike.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # the bound of the broadcast
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    weights, bias = _fitted(rows.select("doc_id", "text", "_label"))
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def apply(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(model.value, bias)
        for texts in frames:
            given = [None if pd.isna(t) else t for t in texts]
            parts = [scorer.scores(given[i : i + CHUNK]) for i in range(0, len(given), CHUNK)]
            yield pd.Series(np.concatenate([*parts, np.zeros(0)]))

    score = F.pandas_udf(apply, "double")
    kept = docs.drop("held_out", "score", "predicted").withColumn("held_out", held_out(F.col("doc_id"), 4))
    scored = kept.withColumn("score", score(F.col("text").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
