"""Packing of tokenized documents into fixed windows by multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.subwords import encoder
from claimspark.session import stage

#: Tokens of remainders that are balanced together.
BLOCK_TOKENS = 1 << 19
#: A remainder is cut into pieces of at most ``capacity // CUT``, small enough to balance windows.
CUT = 4
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` per window, with nearly equal sums.

    Each size starts as a partial partition with one filled window. The two partial partitions
    with the largest spread are merged, the fullest window of one with the emptiest of the other,
    until one is left. Ties go to the earlier index.
    """
    heap, children, sets = [], [], len(sizes)
    for i, size in enumerate(sizes):
        sums, held = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[-1], held[-1] = size, i
        heap.append((-size, i, sums, held))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, first, sums, held = heapq.heappop(heap)
        _, _, other, more = heapq.heappop(heap)
        sums, more = sums + other[::-1], more[::-1]
        both = np.flatnonzero((held >= 0) & (more >= 0))
        joined = np.maximum(held, more)
        if len(both):
            children.append((sets, held[both], more[both]))
            joined[both] = np.arange(sets, sets + len(both))
            sets += len(both)
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]  # only the differences matter from here on
        heapq.heappush(heap, (-int(sums[-1]), first, sums, joined[order]))
    of = np.full(sets, -1)  # the window of each set of pieces
    if heap:
        held = heap[0][3]
        of[held[held >= 0]] = np.flatnonzero(held >= 0)
    for base, left, right in reversed(children):
        of[left] = of[right] = of[base : base + len(left)]
    found = [[] for _ in range(windows)]
    for i, window in enumerate(of[: len(sizes)]):
        found[window].append(i)
    return found


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their number rises until the fullest one fits."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return [w for w in found if w]
        windows += 1


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Cut every document's ids after each ``capacity`` of them, and the rest into smaller pieces."""
    small = max(1, capacity // CUT)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names, rows = frame["doc_id"].tolist(), []
            for i, ids in encoder(tokenizer).encode([None if pd.isna(t) else t for t in frame["text"]]):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                full = len(ids) - len(ids) % capacity
                for at in [*range(0, full, capacity), *range(full, len(ids), small)]:
                    piece = ids[at : at + (capacity if at < full else small)]
                    rows.append((names[i], at, len(piece), zlib.crc32(piece), len(ids)))
            columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            out = pd.DataFrame(rows, columns=columns)
            out["doc_id"] = pd.array([None if pd.isna(d) else int(d) for d in out["doc_id"]], dtype="Int64")
            yield out

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(cut, PIECE_SCHEMA)


def pack(pieces: DataFrame, capacity: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``capacity`` tokens.

    A full piece is a sequence of its own. The others are dealt by a hash of their row into blocks
    of about ``block_tokens`` tokens, which bounds a task at any input size, and each block is
    balanced by ``pack_block``. A column of those two names is replaced; other columns are kept.
    """
    rows = pieces.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id())
    rows = stage(rows, "pieces")  # fixes the row numbers for the passes below
    kept = [c for c in rows.columns if c != "_row"]
    full = rows.filter(F.col("length") == capacity)
    full = full.select(*kept, (F.col("_row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.filter(F.col("length") < capacity)
    tokens = rest.agg(F.sum("length")).scalar()
    blocks = F.greatest(F.lit(1), F.ceil(tokens / F.lit(block_tokens)))
    rest = rest.withColumn("_block", F.pmod(F.xxhash64("_row"), F.coalesce(blocks, F.lit(1))))

    def balance(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row", ignore_index=True)
        sizes, first = frame["length"].tolist(), frame["_row"].to_numpy()
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for window in pack_block(sizes, capacity):
            window.sort()
            ends = np.cumsum([sizes[i] for i in window])
            sequence[window] = first[window[0]] * 2 + 1
            offset[window] = ends - np.array([sizes[i] for i in window])
        return frame.assign(sequence_id=sequence, offset=offset)[kept + ["sequence_id", "offset"]]

    rest = rest.groupBy("_block").applyInPandas(balance, full.schema)
    return full.unionByName(rest)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Encode ``text``, append ``end_id``, cut and pack: one row per piece.

    Null and empty texts are documents of one token, rows of one ``doc_id`` are packed each, other
    columns are ignored, an empty table gives no rows. Returns ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``.
    """
    return pack(token_pieces(docs, tokenizer, end_id, capacity), capacity)
