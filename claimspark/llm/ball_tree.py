"""Exact top-k inner products by branch and bound over ball trees.

The top of one tree, fitted on a bounded sample, deals all vectors into shards, so a shard is a
ball of its own; each shard's tree is built where it is searched. A node with centre ``c`` and
radius ``r`` holds no score above ``q·c + r|q|``. Within a shard queries go down the child of the
higher bound first and cut every subtree below their current k-th score. Between shards that score
is shared in rounds: a query searches its best shard, then the next ones whose bound still
reaches its k-th score, then what is left of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.session import stage

#: Vectors of a shard and queries that meet it in one task.
SHARD_VECTORS = 1 << 14
BLOCK_QUERIES = 1 << 12
#: Vectors that the top of the tree is fitted on; every vector is dealt and searched.
SAMPLE_VECTORS = 20_000
#: Shards per query and round, before the last round takes all that may still matter.
ROUNDS = (1, 4)
LEAF = 128
LOWEST = -(1 << 63) + 2  # below every score, and can be negated
FOUND = "query_id long, vec_id long, score long"


def build(vectors: np.ndarray, leaf: int = LEAF) -> list[tuple[np.ndarray | None, np.ndarray, float, list[int]]]:
    """Nodes as ``(rows, centre, radius, children)``, the root first; only leaves have rows."""
    nodes, todo = [], [(np.arange(len(vectors)), None)]
    while todo:
        rows, above = todo.pop()
        own = vectors[rows].astype(np.float64)
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        if above is not None:
            nodes[above][3].append(len(nodes))
        if len(rows) <= leaf or away.max() == 0:
            nodes.append((rows, centre, away.max(), []))
            continue
        first = own[away.argmax()]
        second = own[((own - first) ** 2).sum(axis=1).argmax()]
        order = np.argsort(own @ (second - first), kind="stable")
        half = len(rows) // 2
        todo += [(rows[order[:half]], len(nodes)), (rows[order[half:]], len(nodes))]
        nodes.append((None, centre, away.max(), []))
    return nodes


def upper_bounds(queries: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No vector of a ball scores above these, one row per query and one column per ball."""
    bounds = queries @ centres.T + norms[:, None] * radii
    return bounds + 1e-9 * (np.abs(bounds) + norms[:, None] * (1 + radii)) + 1e-6  # for rounding


def search(vectors, ids, queries, query_ids, floors, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best ``k`` scores and ids per query (id -1: none) at or above its floor, and visited leaves.

    Raises where a product could leave 64 bits.
    """
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1]
    if most >= 2**63:
        raise OverflowError("inner products of these components do not fit into 64 bits")
    kind = np.float64 if most < 2**53 else np.int64
    best = np.full((len(queries), k), LOWEST - 1, np.int64)
    held = np.full((len(queries), k), -1, np.int64)
    nodes, visited = build(vectors), 0
    own = queries.astype(np.float64)
    norms = np.sqrt((own**2).sum(axis=1))

    def reaching(node: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bound = upper_bounds(own[who], norms[who], nodes[node][1][None], np.array([nodes[node][2]]))[:, 0]
        kept = bound >= np.maximum(floors[who], best[who, -1])
        return who[kept], bound

    def visit(node: int, who: np.ndarray) -> None:
        nonlocal visited
        who, _ = reaching(node, who)
        rows, _, _, children = nodes[node]
        if not len(who):
            return
        if rows is None:
            left, right = children
            nearer = reaching(left, who)[1] >= reaching(right, who)[1]
            visit(left, who[nearer])
            visit(right, who[~nearer])
            visit(right, who[nearer])
            visit(left, who[~nearer])
            return
        visited += len(who)
        scores = (queries[who].astype(kind) @ vectors[rows].astype(kind).T).astype(np.int64)
        names = np.broadcast_to(ids[rows], scores.shape)
        real = (names != query_ids[who][:, None]) & (scores >= floors[who][:, None])
        scores = np.concatenate([best[who], np.where(real, scores, LOWEST - 1)], axis=1)
        names = np.concatenate([held[who], np.where(real, names, -1)], axis=1)
        top = np.lexsort((names, -scores), axis=1)[:, :k]
        best[who], held[who] = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)

    if len(vectors) and len(queries):
        visit(0, np.arange(len(queries)))
    return best, held, visited


# --- dealing --------------------------------------------------------------------------------


def _usable(vectors: DataFrame, scale: int) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter("vec_id is not null and embedding is not null").filter(sound)
    rows = rows.select(F.col("vec_id").cast("long"), whole.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def _arrays(frame: pd.DataFrame, dim: int, column: str = "v") -> np.ndarray:
    return np.array(frame[column].tolist(), np.int64).reshape(len(frame), dim)


class Top:
    """The top of a tree per vector length: routes a vector down to a cell."""

    def __init__(self, sample: pd.DataFrame, share: float, size: int):
        self.nodes, self.splits = {}, {}
        for dim, frame in sample.groupby("dim"):
            own = _arrays(frame, dim)
            self.nodes[dim] = build(own, max(2, int(size * share)))

    def centre(self, dim: int, cell: int) -> np.ndarray:
        return self.nodes[dim][cell][1] if dim in self.nodes else np.zeros(dim)

    def route(self, vectors: np.ndarray, dim: int) -> np.ndarray:
        """Each vector goes to the child with the nearer centre; a length without a sample has one cell."""
        cell = np.zeros(len(vectors), np.int64)
        nodes, todo = self.nodes.get(dim, []), [(0, np.arange(len(vectors)))] if dim in self.nodes else []
        while todo:
            node, who = todo.pop()
            cell[who] = node
            if nodes[node][3] and len(who):
                left, right = nodes[node][3]
                gap = [((vectors[who] - nodes[c][1]) ** 2).sum(axis=1) for c in (left, right)]
                near = gap[0] <= gap[1]
                todo += [(left, who[near]), (right, who[~near])]
        return cell


def _routed(rows: DataFrame, top: Top) -> DataFrame:
    """Rows with their cell and the distance ``away`` from its centre."""

    def route(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, own in frame.groupby("dim"):
                values = _arrays(own, dim).astype(np.float64)
                cell = top.route(values, dim)
                away = np.zeros(len(own))
                for c in np.unique(cell):
                    away[cell == c] = np.sqrt(((values[cell == c] - top.centre(dim, c)) ** 2).sum(axis=1))
                yield own.assign(cell=cell, away=away)

    return rows.mapInPandas(route, "vec_id long, v array<long>, dim int, cell long, away double")


class Shards:
    """Centre and radius of every shard, by vector length."""

    def __init__(self, table: pd.DataFrame, top: Top):
        self.of = {}
        for dim, frame in table.groupby("dim"):
            centres = np.array([top.centre(dim, c) for c in frame["cell"]]).reshape(len(frame), dim)
            self.of[dim] = (frame["shard"].to_numpy(), centres, frame["away"].to_numpy())


def _visits(asks: DataFrame, shards, start: int, stop: int | None) -> DataFrame:
    """``(query_id, shard)``: of a query's shards by descending bound those from ``start`` to ``stop`` that reach its floor."""

    def choose(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names, found = [], []
            for dim, own in frame.groupby("dim"):
                if dim not in shards.value.of:
                    continue
                shard, centres, radii = shards.value.of[dim]
                queries = _arrays(own, dim).astype(np.float64)
                bounds = upper_bounds(queries, np.sqrt((queries**2).sum(axis=1)), centres, radii)
                for query, floor, bound in zip(own["vec_id"], own["floor"], bounds):
                    order = np.argsort(-bound, kind="stable")[start:stop]
                    order = order[bound[order] >= floor]
                    names += [query] * len(order)
                    found.append(shard[order])
            yield pd.DataFrame({"query_id": np.array(names, np.int64), "shard": np.concatenate([*found, np.array([], object)])})

    return asks.mapInPandas(choose, "query_id long, shard string")


def _searched(visits: DataFrame, asks: DataFrame, held: DataFrame, k: int, block: int) -> DataFrame:
    """Shards meet blocks of the queries that visit them, both of bounded size."""

    def meet(query: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        if not len(query) or not len(frame):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        dim, names = int(frame["dim"].iloc[0]), query["query_id"].to_numpy(np.int64)
        best, found, _ = search(
            _arrays(frame, dim), frame["vec_id"].to_numpy(np.int64), _arrays(query, dim, "q"), names, query["floor"].to_numpy(np.int64), k
        )
        here = best >= LOWEST
        return pd.DataFrame({"query_id": np.repeat(names, k)[here.ravel()], "vec_id": found[here], "score": best[here]})

    blocks = visits.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(block)).alias("_blocks"))
    left = visits.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), "_blocks")).drop("_blocks")
    # New names, as queries and vectors come from one table.
    own = asks.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "floor")
    right = held.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    keys = ["shard", "block"]
    return left.join(own, "query_id").groupBy(*keys).cogroup(right.drop("_blocks").groupBy(*keys)).applyInPandas(meet, FOUND)


def top_k(
    vectors: DataFrame, every: int, k: int, scale: int = 256, shard: int = SHARD_VECTORS, block: int = BLOCK_QUERIES, sample: int = SAMPLE_VECTORS
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best partners of every ``every``-th ``vec_id``.

    Components become ``floor(scale * x)``; ties go to the smaller ``vec_id``. Null vectors, null
    ids and vectors with null or non-finite components take no part; vectors of other lengths do
    not meet. Of rows that repeat a ``vec_id`` the one with the smallest vector counts. Empty
    vectors all score 0. Other columns are ignored; an empty table gives no rows. Products that
    may leave 64 bits raise. Of equal vectors only the ``k + 1`` smallest ids are searched, as no
    query can rank another.
    """
    rows = stage(_usable(vectors, scale), "vectors")
    same = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_copy", F.row_number().over(same)).filter(F.col("_copy") <= k + 1).drop("_copy")
    total = rows.count()
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    top = Top(fitted, len(fitted) / max(total, 1), shard)
    routed = stage(_routed(few, top), "routed")
    subs = routed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(2 * shard)).alias("_subs"))
    name = F.concat_ws("|", "dim", "cell", F.pmod(F.xxhash64("vec_id"), "_subs"))
    held = routed.join(subs, ["dim", "cell"]).withColumn("shard", name)  # a cell far above its size is dealt by hash
    table = held.groupBy("dim", "cell", "shard").agg(F.max("away").alias("away")).toPandas()  # one row per shard
    shards = vectors.sparkSession.sparkContext.broadcast(Shards(table, top))
    held = held.select("vec_id", "v", "dim", "shard")
    asks = rows.filter(F.col("vec_id") % every == 0).withColumn("floor", F.lit(LOWEST).cast("long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, start = None, 0
    for stop in (*(sum(ROUNDS[: i + 1]) for i in range(len(ROUNDS))), None):
        visits = stage(_visits(asks, shards, start, stop), "visits")
        scored = _searched(visits, asks, held, k, block)
        scored = scored if found is None else found.drop("rank").unionByName(scored)
        found = stage(scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "found")
        shared = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("_kth"))
        asks = asks.join(shared, "vec_id", "left").withColumn("floor", F.coalesce("_kth", "floor")).drop("_kth")
        asks, start = stage(asks, "queries"), stop
    return found.select("query_id", "rank", "vec_id", "score")
