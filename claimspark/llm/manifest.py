"""A Merkle manifest of a table: one tree of arity 3 per source, and one over the sources' roots.

A tree is cut into aligned blocks of ``3 ** HEIGHT`` leaves. A block's nodes lie in one array in
van Emde Boas order: a tree of some levels is split at half height into a top and the bottoms
below it, stored one after the other, and each of them is split in the same way, down to single
nodes. ``address`` computes a node's place from its level and position; construction and sibling
retrieval use nothing else, whatever a memory block holds. The roots of a level of blocks are the
leaves of the next level, until a tree has one block left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.session import pin, stage

ARITY = 3
#: Levels above the leaves of a full block: 2,187 leaves, 105 kB of nodes.
HEIGHT = 7
DIGEST = 32
BLOCK_SCHEMA = (
    "tree string, block long, n long, levels int, nodes binary, root binary, "
    "rows array<struct<doc_id: long, tampered: binary>>"
)
PATH_SCHEMA = "tree string, idx long, path binary, subroot binary, root binary"


def subtree_size(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, position: np.ndarray) -> np.ndarray:
    """Places of the nodes at ``depth`` (0 is the root) of a tree of ``levels`` in its array."""
    if levels == 1:
        return np.zeros_like(position)
    top = levels // 2
    if depth < top:
        return address(top, depth, position)
    below = ARITY ** (depth - top)  # nodes of one bottom at this depth
    inside = address(levels - top, depth - top, position % below)
    return subtree_size(top) + position // below * subtree_size(levels - top) + inside


@lru_cache(maxsize=None)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """The places of a whole tree's nodes, one array per depth."""
    return tuple(address(levels, d, np.arange(ARITY**d)) for d in range(levels))


def height_of(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def parent(digests: Iterable[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class Block:
    """The nodes of an aligned subtree in van Emde Boas order; absent nodes are zero."""

    def __init__(self, levels: int, leaves: int, nodes: np.ndarray):
        self.levels, self.nodes = levels, nodes
        self.width = [leaves]  # present nodes per depth, the leaves first
        for _ in range(levels - 1):
            self.width.append(-(-self.width[-1] // ARITY))
        self.width.reverse()

    @classmethod
    def of(cls, leaves: list[bytes], levels: int) -> Block:
        block = cls(levels, len(leaves), np.zeros((subtree_size(levels), DIGEST), np.uint8))
        block._fill(0, levels, leaves)
        return block

    def _fill(self, base: int, levels: int, leaves: list[bytes]) -> bytes:
        """Store the subtree at ``base``: its bottoms first, then the top over their roots."""
        if levels == 1:
            self.nodes[base] = np.frombuffer(leaves[0], np.uint8)
            return leaves[0]
        top = levels // 2
        below, size = ARITY ** (levels - top - 1), subtree_size(levels - top)
        at = base + subtree_size(top)
        roots = []
        for i in range(0, len(leaves), below):
            roots.append(self._fill(at, levels - top, leaves[i : i + below]))
            at += size
        # One more level lies between the bottoms' roots and the top's leaves.
        return self._fill(base, top, [parent(roots[i : i + ARITY]) for i in range(0, len(roots), ARITY)])

    @property
    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def leaf(self, position: int) -> bytes:
        return self.nodes[addresses(self.levels)[-1][position]].tobytes()

    def path(self, position: int) -> bytes:
        """Per level, from the leaf up: own place in the run, number of siblings, the siblings."""
        found = []
        for depth in range(self.levels - 1, 0, -1):
            first = position - position % ARITY
            run = np.arange(first, min(first + ARITY, self.width[depth]))
            siblings = addresses(self.levels)[depth][run[run != position]]
            found += [bytes([position - first, len(siblings)]), self.nodes[siblings].tobytes()]
            position //= ARITY
        return b"".join(found)


def siblings_of(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        place, count = path[at], path[at + 1]
        at += 2
        yield place, [path[at + i * DIGEST : at + (i + 1) * DIGEST] for i in range(count)]
        at += count * DIGEST


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path's siblings give."""
    for place, run in siblings_of(path):
        leaf = parent([*run[:place], leaf, *run[place:]])
    return leaf


def proof(path: bytes) -> str:
    """``H`` over the siblings of a path, from the leaf to the root."""
    return parent([s for _, run in siblings_of(path) for s in run]).hex()


# --- leaves ---------------------------------------------------------------------------------


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 over each field's UTF-8 byte count, a colon and the field; a null is one dash."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """``(tree, doc_id, digest, tampered)``: the texts are read and hashed once, here."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    whole = leaf_digest(*[F.col(c) for c in fields])
    changed = leaf_digest(*[F.col(c) for c in fields[:-1]], F.replace("text", F.lit("\n"), F.lit("")))
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return docs.select(
        # Null and text keep their order: nulls first, then bytewise.
        F.concat(F.lit("="), "source").alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        whole.alias("digest"),
        F.when(drawn & F.contains("text", F.lit("\n")), changed).alias("tampered"),
    )


def _key(c: str = "tree") -> Column:
    """A join key that null has too."""
    return F.coalesce(F.col(c), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``idx`` (from 0 within its tree) and ``n`` (rows of the tree), in ``order`` inside a tree.

    Two phases: rows are range-partitioned by tree and order, so a hot tree spreads over many
    tasks, and pinned; then each (partition, tree) gets the rows of its tree in earlier ones.
    """
    by = [F.col("tree").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    pinned = pin(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    pinned = pinned.withColumn("_part", F.shiftright("_at", 33)).withColumn("_key", _key())
    tree = Window.partitionBy("_key")
    earlier = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        pinned.groupBy("_part", "_key")
        .agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
        .withColumn("n", F.sum("_rows").over(tree))
        .withColumn("_base", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first"))
        .select("_part", "_key", "n", "_base")
    )
    found = pinned.join(starts, ["_part", "_key"]).withColumn("idx", F.col("_at") + F.col("_base"))
    return found.select(*rows.columns, "idx", "n")


# --- blocks ---------------------------------------------------------------------------------


def blocks_of(nodes: DataFrame, height: int) -> DataFrame:
    """One row per aligned block of ``nodes (tree, idx, n, digest, doc_id, tampered)``.

    A tree of one block ends at its root; the blocks of a larger one all reach ``height`` levels,
    the last and shorter one too. A task streams its blocks and holds one of them.
    """
    width = ARITY**height

    def row(tree, block: int, n: int, digests: list[bytes], names: list, tampered: list) -> dict:
        built = Block.of(digests, 1 + (height if n > width else height_of(n)))
        pairs = [{"doc_id": None if pd.isna(d) else int(d), "tampered": t} for d, t in zip(names, tampered)]
        return {
            "tree": tree, "block": block, "n": n, "levels": built.levels,
            "nodes": built.nodes.tobytes(), "root": built.root, "rows": pairs,
        }

    def build(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        columns = ["tree", "block", "n", "digest", "doc_id", "tampered"]

        def rows(frame: pd.DataFrame, bounds: list[int]) -> Iterator[pd.DataFrame]:
            values = [frame[c].tolist() for c in columns]
            for i in range(0, len(bounds) - 1, 64):
                cut = bounds[i : i + 65]
                found = [row(*[v[x] for v in values[:3]], *[v[x:y] for v in values[3:]]) for x, y in zip(cut, cut[1:])]
                yield pd.DataFrame(found)

        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            frame["tree"] = frame["tree"].astype(object).where(frame["tree"].notna(), None)
            key = (frame["tree"].fillna("") + "\u0000" + frame["block"].astype(str)).to_numpy()
            bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
            yield from rows(frame, bounds)
            held = frame.iloc[bounds[-1] :]
        if held is not None and len(held):
            yield from rows(held, [0, len(held)])

    dealt = nodes.select(
        "tree", F.floor(F.col("idx") / F.lit(width)).alias("block"), "idx", "n", "digest",
        F.col("doc_id").cast("string").alias("doc_id"), "tampered",
    )
    dealt = dealt.repartition(_key(), "block").sortWithinPartitions(_key(), "block", "idx")
    return dealt.drop("idx").mapInPandas(build, BLOCK_SCHEMA)


def forest(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The staged blocks of every level: level 0 over the leaves, each next over the roots below."""
    levels, width = [], ARITY**height
    while True:
        blocks = stage(blocks_of(nodes, height), f"merkle-blocks-{len(levels)}")
        levels.append(blocks)
        open_trees = blocks.filter(F.col("n") > width)
        if open_trees.isEmpty():
            return levels
        nodes = open_trees.select(
            "tree", F.col("block").alias("idx"), F.ceil(F.col("n") / F.lit(width)).alias("n"),
            F.col("root").alias("digest"), F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("binary").alias("tampered"),
        )


def tops(levels: list[DataFrame], height: int) -> DataFrame:
    """``(tree, root)``: every tree ends in its only block of some level."""
    ends = [b.filter(F.col("n") <= ARITY**height).select("tree", "root") for b in levels]
    found = ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    return found


def _with_paths(blocks: DataFrame, final: DataFrame, above: DataFrame | None, height: int) -> DataFrame:
    """Blocks with the path from their root up: of the tree's end for its last block, else of the level above."""
    last = blocks.filter(F.col("n") <= ARITY**height).withColumn("_key", _key())
    ends = final.select(_key().alias("_key"), F.col("path").alias("_path"), F.col("root").alias("_top"))
    found = last.join(ends, "_key").withColumn("_sub", F.col("root")).drop("_key")
    if above is None:
        return found
    rest = blocks.filter(F.col("n") > ARITY**height).withColumn("_key", _key())
    upper = above.select(
        _key().alias("_key"), F.col("idx").alias("block"), F.col("path").alias("_path"),
        F.col("root").alias("_top"), F.col("subroot").alias("_sub"),
    )
    return found.unionByName(rest.join(upper, ["_key", "block"]).drop("_key"))


def _blocks(frame: pd.DataFrame) -> Iterator[tuple[dict, Block]]:
    for row in frame.to_dict("records"):
        nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST)
        yield row, Block(row["levels"], len(row["rows"]), nodes)


def paths_of(blocks: DataFrame, height: int) -> DataFrame:
    """``(tree, idx, path, subroot, root)`` of every node that the blocks hold as a leaf."""

    def walk(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row, block in _blocks(frame):
                count, first = len(row["rows"]), row["block"] * ARITY**height
                paths = [block.path(i) + row["_path"] for i in range(count)]
                yield pd.DataFrame(
                    {"tree": row["tree"], "idx": first + np.arange(count), "path": paths, "subroot": row["_sub"], "root": row["_top"]}
                )

    return blocks.mapInPandas(walk, PATH_SCHEMA)


def manifest_proofs(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row of ``docs``.

    Leaves hash ``doc_id, source, lang, n_chars, text``; other columns are ignored whatever their
    names. Within a source they ascend by ``doc_id``, nulls first, equal ids by digest, so
    repeated rows are leaves each. A null source is a source of its own, apart from the empty one.
    A text is tampered with where ``crc32`` of the decimal ``doc_id`` is even; a null ``doc_id``
    has none and stays. An empty table gives no rows; a single leaf is its own root and its proof
    is the hash of nothing. Texts never shuffle; a task holds one block of ``3 ** height`` leaves.
    """
    leaves = numbered(leaf_rows(docs), ["doc_id", "digest"])
    levels = forest(leaves, height)
    subroots = tops(levels, height).select(
        F.lit(None).cast("string").alias("tree"), F.col("tree").alias("_source"), F.col("root").alias("digest"),
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered"),
    )
    sources = stage(numbered(subroots, ["_source"]), "merkle-sources")
    top = forest(sources.drop("_source"), height)
    root = tops(top, height).select("tree", F.lit(b"").alias("path"), "root")
    above = None
    for blocks in reversed(top):
        above = paths_of(_with_paths(blocks, root, above, height), height)
    final = sources.select("_source", "idx").join(above.select("idx", "path", "root"), "idx")
    final = stage(final.select(F.col("_source").alias("tree"), "path", "root"), "merkle-source-paths")
    above = None
    for blocks in reversed(levels[1:]):
        above = stage(paths_of(_with_paths(blocks, final, above, height), height), "merkle-paths")

    def judge(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row, block in _blocks(frame):
                found = []
                for i, own in enumerate(row["rows"]):
                    path, leaf = block.path(i) + row["_path"], block.leaf(i)
                    again = folded(leaf if own["tampered"] is None else own["tampered"], path)
                    name = None if pd.isna(own["doc_id"]) else int(own["doc_id"])
                    found.append((name, leaf.hex(), proof(path), again.hex(), again == row["_top"]))
                out = pd.DataFrame(found, columns=["doc_id", "leaf", "proof_sha256", "folded_root", "verified"])
                out["doc_id"] = pd.array(out["doc_id"].tolist(), dtype="Int64")
                yield out.assign(subroot=row["_sub"].hex(), root=row["_top"].hex())

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    judged = _with_paths(levels[0], final, above, height)
    return judged.mapInPandas(judge, schema)
