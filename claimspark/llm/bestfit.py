"""Packing of whole documents by bounded-space online best fit.

Pieces stream through a fixed number of open bins. A piece goes into the open bin that it fills
best; where none has room it opens a bin, and if that is one too many the fullest closes first.
The open bins are found by their free space in a bitset, so a placement is one shift and one
lowest-bit search whatever the number of bins, and the state of a stream never grows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.subwords import encoder
from claimspark.session import stage

#: Bins a stream keeps open; a stream gets about as many tokens as they hold.
OPEN_BINS = 2048
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """At most ``limit`` open bins of ``capacity``, in a bitset keyed by free space."""

    def __init__(self, capacity: int, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.bits, self.count = 0, 0  # bit f: some open bin has f free
        self.of: dict[int, deque[int]] = {}  # open bins by free space, the oldest first

    def _take(self, free: int) -> int:
        bins = self.of[free]
        name = bins.popleft()
        if not bins:
            del self.of[free]
            self.bits ^= 1 << free
        self.count -= 1
        return name

    def _put(self, name: int, free: int) -> None:
        if free:  # a full bin closes
            self.of.setdefault(free, deque()).append(name)
            self.bits |= 1 << free
            self.count += 1

    def place(self, length: int, name: int) -> tuple[int, int]:
        """``(bin, offset)`` for a piece; a bin that it opens is called ``name``."""
        if length == self.capacity:
            return name, 0
        roomy = self.bits >> length
        if roomy:
            free = length + (roomy & -roomy).bit_length() - 1  # the least that suffices
            found = self._take(free)
            self._put(found, free - length)
            return found, self.capacity - free
        if self.count == self.limit:
            self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        self._put(name, self.capacity - length)
        return name, 0


def whole_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per document with its ids and ``end_id``; only longer ones are cut, at ``capacity``."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names, rows = frame["doc_id"].tolist(), []
            for i, ids in encoder(tokenizer).encode([None if pd.isna(t) else t for t in frame["text"]]):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for n, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    rows.append((names[i], n, at, len(own), zlib.crc32(own)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = pd.array([None if pd.isna(d) else int(d) for d in out["doc_id"]], dtype="Int64")
            yield out

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(cut, PIECE_SCHEMA)


def best_fit(pieces: DataFrame, capacity: int, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    The pieces are dealt by hash into streams of about ``capacity * open_bins`` tokens. Each
    arrives in descending length, ties by row number: the small pieces then fill the gaps, and a
    task that runs again gives the same bins. A stream holds its open bins and one batch of rows,
    whatever its length. Columns of those two names are replaced, all others kept.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = stage(pieces.select(*kept, F.monotonically_increasing_id().alias("_row")), "whole-pieces")
    tokens = rows.agg(F.sum("length")).first()[0] or 0
    streams = max(1, -(-tokens // (capacity * open_bins)))
    dealt = rows.repartition(streams, "_row").sortWithinPartitions(F.desc("length"), "_row")

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = OpenBins(capacity, open_bins)
        for frame in frames:
            placed = [bins.place(n, row) for n, row in zip(frame["length"].tolist(), frame["_row"].tolist())]
            at = np.array(placed, np.int64).reshape(-1, 2)
            yield frame[["_row"]].assign(sequence_id=at[:, 0], offset=at[:, 1])

    # Only numbers pass through Python; the columns that are kept wait in the staged table.
    places = dealt.select("_row", "length").mapInPandas(place, "_row long, sequence_id long, offset long")
    return rows.join(places, "_row").select(*kept, "sequence_id", "offset")


def best_fit_documents(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, open_bins: int = OPEN_BINS
) -> DataFrame:
    """Encode ``text``, append ``end_id`` and pack whole documents: one row per piece.

    Null and empty texts are documents of one token, rows of one ``doc_id`` (null included) are
    packed each, other columns are ignored whatever their names, a longer document than
    ``capacity`` is cut after every ``capacity`` ids, an empty table gives no rows. Returns
    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; ``sequence_id`` is the
    staged row number of the piece that opened the sequence.
    """
    return best_fit(whole_pieces(docs, tokenizer, end_id, capacity), capacity, open_bins)
