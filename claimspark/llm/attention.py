"""Language-model scores by causal self-attention over subword ids, and word unigram scores.

The attention layer learns from every window of every training text: each task trains a replica in numpy,
and Spark averages the replicas after each round. Its softmax is a Huffman tree over all ids, whose
nodes start from the counts of the training texts and learn a vector each; no other model takes part.
Each text is encoded once and its ids are written. Windows of ``WINDOW`` ids overlap by ``OVERLAP``; every id is
scored once, in the first window that holds it past the overlap. Word counts grow with the
corpus: only the most frequent, at most ``TOP_WORDS`` short ones, are broadcast, and the rest is joined.
"""

from __future__ import annotations

import copy
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.ngram_join import LOWER, UPPER
from claimspark.llm.subwords import encoder
from claimspark.llm.toxicity import held_out
from claimspark.session import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW, OVERLAP = 48, 12
DIM = 16
BATCH, RATE = 64, 0.01
#: Rounds of a pass over the training texts, after each of which the replicas are averaged.
ROUNDS = 3
#: Passes are repeated until the model has seen so many ids, at most so often; the first is always whole.
FEW_IDS, MAX_PASSES = 3_000_000, 8
#: Ids of a long text that are cut into windows at once, and windows that are shuffled together.
SPAN, HELD = 100_000, 4_096
#: Characters of texts that are encoded together, and pieces whose ids a task keeps meanwhile.
ENCODED, PIECES = 1_000_000, 300_000
#: Rows of the table that are averaged together.
BLOCK = 1_024
TOP_WORDS, TOP_CHARS = 50_000, 40
#: Windows that are scored together.
GROUP = 64
FOLDS = 7


class Tree:
    """Huffman tree over the ids: the path of each id, and the log odds of its counts at every node."""

    def __init__(self, counts: np.ndarray):
        mass = (np.asarray(counts, np.float64) + 1.0).tolist()
        ids = len(mass)
        heap = [(m, i) for i, m in enumerate(mass)]
        heapq.heapify(heap)
        above, right = np.zeros(2 * ids - 1, np.int64), np.zeros(2 * ids - 1, np.int8)
        self.bias = np.zeros(max(1, ids - 1), np.float32)
        for node in range(ids, 2 * ids - 1):
            (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
            above[a] = above[b] = node
            right[b] = 1
            self.bias[node - ids] = np.log(y) - np.log(x)
            heapq.heappush(heap, (x + y, node))
        of, nodes, sides, at = [], [], [], np.arange(ids)
        live = at < 2 * ids - 2
        while live.any():
            of.append(np.flatnonzero(live))
            nodes.append(above[at[live]] - ids)
            sides.append(right[at[live]])
            at = np.where(live, above[at], at)
            live = at < 2 * ids - 2
        of, nodes, sides = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (of, nodes, sides))
        order = np.argsort(of, kind="stable")
        self.nodes, self.sign = nodes[order].astype(np.int32), (2.0 * sides[order] - 1).astype(np.float32)
        self.size = np.bincount(of, minlength=ids)
        self.start = np.cumsum(self.size) - self.size

    def paths(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position in ``target``, node and sign of every step to the targets."""
        size = self.size[target]
        owner = np.repeat(np.arange(len(target)), size)
        at = np.arange(len(owner)) + np.repeat(self.start[target] - (np.cumsum(size) - size), size)
        return owner, self.nodes[at], self.sign[at]


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their rows of ``values``."""
    small = len(keys) and keys.max() < 1 << 16  # sorted by digits then
    order = np.argsort(keys.astype(np.uint16) if small else keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(_rows(values, order), starts, axis=0)


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``table[at]`` for places known to be in it."""
    return np.take(table, at, axis=0, mode="clip")


class Attention:
    """One causal self-attention head with learned positions, from ids to the probability of the next.

    All parameters are rows of one table: embeddings, tree nodes, positions and the five matrices.
    """

    def __init__(self, tree: Tree, seed: int = 1):
        self.tree, self.ids = tree, len(tree.size)
        rows = {"embed": self.ids + 1, "node": len(tree.bias), "place": WINDOW, **dict.fromkeys(("q", "k", "v", "out", "last"), DIM)}
        self.at = dict(zip(rows, np.cumsum([0, *rows.values()]).tolist()))
        self.table = np.random.default_rng(seed).normal(0, 0.2, (sum(rows.values()), DIM)).astype(np.float32)
        self.table[self.at["node"] : self.at["place"]] = 0  # the probabilities of the counts, to start with
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)

    def part(self, name: str) -> np.ndarray:
        start = self.at[name]
        return self.table[start : start + {"embed": self.ids + 1, "node": len(self.tree.bias), "place": WINDOW}.get(name, DIM)]

    def forward(self, ids: np.ndarray):
        """``ids``: windows of inputs, where position t predicts the id after it."""
        p, t = self.part, ids.shape[1]
        x = _rows(p("embed"), ids) + p("place")[:t]
        q, k, v = x @ p("q"), x @ p("k"), x @ p("v")
        a = q @ k.swapaxes(1, 2) * np.float32(DIM**-0.5) + self.mask[:t, :t]
        a = np.exp(a - a.max(axis=2, keepdims=True))
        a /= a.sum(axis=2, keepdims=True)
        h = a @ v
        return h @ p("out") + x @ p("last"), (x, q, k, v, a, h)

    def steps(self, z: np.ndarray, target: np.ndarray):
        """Owner, node, sign and signed logit of every step from the rows of ``z`` to ``target``, and both sides of its product."""
        owner, node, sign = self.tree.paths(target)
        sides = _rows(z, owner), _rows(self.part("node"), node)
        logit = np.einsum("nd,nd->n", *sides) + self.tree.bias[node]
        return owner, node, sign, sign * logit, sides

    def logs(self, ids: np.ndarray, target: np.ndarray, new: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of every target; over all ids they sum to 1. Those that are not ``new`` get 0."""
        asked = np.arange(target.size) if new is None else np.flatnonzero(new.ravel())
        owner, _, _, logit, _ = self.steps(_rows(self.forward(ids)[0].reshape(-1, DIM), asked), target.ravel()[asked])
        lost = np.maximum(-logit, 0) + np.log1p(np.exp(-np.abs(logit)))
        found = np.zeros(target.size)
        found[asked] = -np.bincount(owner, lost, len(asked)) / np.log(10)
        return found.reshape(target.shape)

    def gradients(self, ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table that the targets of a weight bear on, and their gradient of the mean loss."""
        p, scale, t = self.part, np.float32(DIM**-0.5), ids.shape[1]
        z, (x, q, k, v, a, h) = self.forward(ids)
        asked = np.flatnonzero(weight.ravel())
        flat = z.reshape(-1, DIM)[asked]
        owner, node, sign, logit, (above, below) = self.steps(flat, target.ravel()[asked])
        slope = (-sign / (1 + np.exp(np.clip(logit, -60, 60))) / max(1, len(asked))).astype(np.float32)[:, None]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        dz = np.zeros((z.size // DIM, DIM), np.float32)
        dz[asked] = np.add.reduceat(np.multiply(slope, below, out=below), starts, axis=0)
        dz = dz.reshape(z.shape)
        dh = dz @ p("out").T
        da, dv = dh @ v.swapaxes(1, 2), a.swapaxes(1, 2) @ dh
        ds = a * (da - (da * a).sum(axis=2, keepdims=True)) * scale
        dq, dk = ds @ k, ds.swapaxes(1, 2) @ q
        dx = dz @ p("last").T + dq @ p("q").T + dk @ p("k").T + dv @ p("v").T
        wide = lambda m: m.reshape(-1, DIM)
        seen, moved = _sums(ids.ravel(), wide(dx))
        met, drawn = _sums(node, np.multiply(slope, above, out=above))
        place = np.zeros((WINDOW, DIM), np.float32)
        place[:t] = dx.sum(0)
        dense = [wide(x).T @ wide(d) for d in (dq, dk, dv)] + [wide(h).T @ wide(dz), wide(x).T @ wide(dz)]
        rows = [seen, met + self.at["node"], np.arange(self.at["place"], len(self.table))]
        return np.concatenate(rows), np.concatenate([moved, drawn, place, *dense])


class Learner:
    """A replica of the model that one task trains by Adam; rows that a batch lacks are left alone."""

    def __init__(self, model: Attention, seed: int):
        self.model, self.rng, self.step = model, np.random.default_rng(seed), 0
        self.mean, self.square = np.zeros_like(model.table), np.zeros_like(model.table)
        self.times = np.zeros(len(model.table))

    def learn(self, given: np.ndarray, target: np.ndarray, new: np.ndarray) -> None:
        """One pass over the windows, in random order."""
        order = self.rng.permutation(len(given))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            rows, grad = self.model.gradients(given[pick], target[pick], new[pick])
            self.step += 1
            self.times[rows] += 1
            mean, square = 0.9 * _rows(self.mean, rows) + 0.1 * grad, 0.99 * _rows(self.square, rows) + 0.01 * grad * grad
            self.mean[rows], self.square[rows] = mean, square
            move = mean / (1 - 0.9**self.step) / (np.sqrt(square / (1 - 0.99**self.step)) + 1e-8)
            self.model.table[rows] -= np.float32(RATE) * move


def _unpacked(raw: bytes, vocabulary: int) -> np.ndarray:
    return np.frombuffer(raw, _id_type(vocabulary))


def _id_type(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def _packed(texts: list[str], tokenizer: str, vocabulary: int) -> list[bytes]:
    return [ids.astype(_id_type(vocabulary)).tobytes() for _, ids in encoder(tokenizer, PIECES).encode(texts)]


def _bounded(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about ``ENCODED`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= ENCODED:
            yield held
            held, size = [], 0
    if held:
        yield held


def _part() -> Column:
    """The round of a pass that learns from a text."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).alias("part")


def trained(train: DataFrame, tokenizer: str, frequency: np.ndarray) -> Attention:
    """The model after passes over all windows of all texts of ``train``, each encoded once."""
    size = len(frequency)

    @F.pandas_udf("binary")
    def packed(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield from (pd.Series(_packed(part, tokenizer, size)) for part in _bounded(texts.tolist()))

    return fitted(stage(train.select(_part(), packed("text").alias("ids")), "encoded"), frequency)


def fitted(train: DataFrame, frequency: np.ndarray) -> Attention:
    """The model after passes over all windows of ``train``: the packed ``ids`` of texts and their ``part``.

    A pass has ``ROUNDS`` rounds over disjoint parts of the texts. In a round every task trains a replica on
    its texts; Spark averages each row of the table over the replicas that changed it, by their
    steps. The driver gets one averaged table, whatever the number of texts and tasks.
    """
    size, model, known = len(frequency), Attention(Tree(frequency)), int(frequency.sum())
    end = size - 1
    passes = min(MAX_PASSES, -(-FEW_IDS // max(1, known))) if known else 0
    context = train.sparkSession.sparkContext
    for turn in range(passes * ROUNDS):
        shared = context.broadcast(model)

        def learn(frames: Iterator[pd.DataFrame], shared=shared, turn=turn) -> Iterator[pd.DataFrame]:
            learner, held, waiting = None, [], 0

            def flush():
                learner.learn(*(np.concatenate(x) for x in zip(*held)))

            for frame in frames:
                for raw in frame["ids"]:
                    learner = learner or Learner(copy.deepcopy(shared.value), turn)
                    whole = np.append(_unpacked(raw, size), end)
                    for i in range(0, len(whole), SPAN):  # long texts by bounded spans, each after its last id
                        held.append(windows(whole[i : i + SPAN], whole[i - 1] if i else size))
                        waiting += len(held[-1][0])
                        if waiting >= HELD:
                            flush()
                            held, waiting = [], 0
            if held:
                flush()
            if learner:
                changed = np.flatnonzero(learner.times)
                for block in np.split(changed, np.flatnonzero(np.diff(changed // BLOCK)) + 1):
                    times = learner.times[block]
                    values = learner.model.table[block] * times[:, None]
                    yield pd.DataFrame({"block": [block[0] // BLOCK], "at": [block.tobytes()], "w": [times.tobytes()], "v": [values.tobytes()]})

        def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for frame in frames:
                for block, at, w, v in zip(frame["block"], frame["at"], frame["w"], frame["v"]):
                    held = sums.setdefault(block, np.zeros((BLOCK, DIM + 1)))
                    at = np.frombuffer(at, np.int64) - block * BLOCK
                    held[at, :DIM] += np.frombuffer(v).reshape(-1, DIM)
                    held[at, DIM] += np.frombuffer(w)
            for block, held in sums.items():
                at = np.flatnonzero(held[:, DIM])
                mean = (held[at, :DIM] / held[at, DIM:]).astype(np.float32)
                yield pd.DataFrame({"at": [(at + block * BLOCK).tobytes()], "v": [mean.tobytes()]})

        parts = train.filter(F.col("part") == turn % ROUNDS).select("ids").mapInPandas(learn, "block long, at binary, w binary, v binary")
        for r in parts.repartition("block").mapInPandas(add, "at binary, v binary").collect():  # one table
            model.table[np.frombuffer(r["at"], np.int64)] = np.frombuffer(r["v"], np.float32).reshape(-1, DIM)
        shared.unpersist()
    return model


def windows(ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and the mask of targets to score, each once; ``start`` precedes the text."""
    stride = WINDOW - OVERLAP
    before = np.concatenate([[start], ids[:-1]]).astype(np.int64)
    count = 1 + max(0, -(-(len(ids) - WINDOW) // stride))
    at = np.arange(count)[:, None] * stride + np.arange(WINDOW)
    inside = at < len(ids)
    at = np.minimum(at, len(ids) - 1)
    new = inside & ((np.arange(WINDOW) >= OVERLAP) | (np.arange(count)[:, None] == 0))
    return before[at], ids[at].astype(np.int64), new


class Scorer:
    """Scores whole texts window by window."""

    def __init__(self, model: Attention):
        self.model = model

    def totals(self, texts: Iterable[np.ndarray], count: int, start: int) -> np.ndarray:
        """log10 probability per list of ids, of ``count`` lists that are read one by one."""
        total, held, owners, waiting = np.zeros(count), [], [], 0

        def flush():
            given, target, new = (np.concatenate(x) for x in zip(*held))
            owner = np.concatenate(owners)
            for i in range(0, len(given), GROUP):
                part = slice(i, i + GROUP)
                np.add.at(total, owner[part], self.model.logs(given[part], target[part], new[part]).sum(axis=1))

        for i, ids in enumerate(texts):
            held.append(windows(ids, start))
            owners.append(np.full(len(held[-1][0]), i))
            waiting += len(owners[-1])
            if waiting >= 32 * GROUP:
                flush()
                held, owners, waiting = [], [], 0
        if held:
            flush()
        return total


def text_scores(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A-Z are lower-cased; tokens are words and one end. Rows of the held-out fold are not learned
    from; a null ``doc_id`` is. Null and empty texts hold the end alone. ``base_score`` is the add-one
    unigram log10 probability of the tokens, ``score`` the model's of the subword ids and an end.
    Equal rows are counted and scored each, other columns are ignored, an empty table gives no rows.
    Without training texts all ids follow an even tree and N and V are 0.
    """
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col("doc_id").cast("long"), lowered.alias("text")).withColumn("held_out", held_out(F.col("doc_id"), FOLDS))
    train = rows.filter("not held_out")
    words = train.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    counts = stage(words.groupBy("word").agg(F.count("*").alias("c")), "word-counts")
    ends = train.count()
    spoken, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = spoken + ends, distinct + (1 if ends else 0)
    short = counts.filter(F.length("word") <= TOP_CHARS).orderBy(F.desc("c"), "word").limit(TOP_WORDS)
    top = {r["word"]: r["c"] for r in short.collect()}  # bounded by count and length

    size = encoder(tokenizer, PIECES).tokenizer.get_vocab_size()
    end = size - 1

    def encode(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # The rows of a frame are many; what is made of them leaves in parts.
        for texts in (part for frame in frames for part in _bounded(frame.tolist())):
            ids = _packed(texts, tokenizer, size)
            n, known, base, rare = [], [], [], []
            for text in texts:
                own = WORD.findall(text)
                seen = np.array([common.value.get(w, 0) for w in own] + [ends], np.float64)
                n.append(len(own) + 1)
                known.append(int((seen > 0).sum()))
                base.append(float(np.log10(seen[seen > 0] + 1).sum()))
                rare.append([w for w, c in zip(own, seen) if not c])
            yield pd.DataFrame({"ids": ids, "n_tokens": n, "n_known": known, "base": base, "rare": rare})

    common = docs.sparkSession.sparkContext.broadcast(top)
    schema = "ids binary, n_tokens long, n_known long, base double, rare array<string>"
    encoded = rows.select("doc_id", "held_out", _part(), F.pandas_udf(encode, schema)("text").alias("s")).select("doc_id", "held_out", "part", "s.*")
    # Every text is encoded once: counts, rounds and scores read its ids.
    encoded = stage(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    learned = encoded.filter("not held_out")

    def count_ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            times = np.zeros(size, np.int64)
            for raw in frame["ids"]:
                times += np.bincount(_unpacked(raw, size), minlength=size)
            times[end] += len(frame)
            yield pd.DataFrame({"id": np.flatnonzero(times), "c": times[times > 0]})

    frequency = np.zeros(size, np.int64)
    # At most one row per id of the vocabulary.
    for r in learned.select("ids").mapInPandas(count_ids, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():
        frequency[r["id"]] = r["c"]
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(fitted(learned, frequency)))

    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in frames:
            ids = (np.append(_unpacked(raw, size), end).astype(np.int64) for raw in batch)
            yield pd.Series(shared.value.totals(ids, len(batch), size))

    scored = encoded.withColumn("score", F.pandas_udf(score, "double")("ids")).drop("ids", "part", "rare")
    rare = encoded.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n"))
    met = rare.hint("merge").join(counts, "word").groupBy("row").agg(
        F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("added")
    )
    joined = scored.hint("merge").join(met, "row", "left")
    whole = F.col("base") + F.coalesce("added", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + kinds + 1))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), whole.alias("base_score"), "score",
    )
