"""Token-id files whose document boundaries are Elias-Fano coded.

A file is a series of segments, each followed by one line feed. A segment holds up to
``SEGMENT_IDS`` ids (or one longer document) of consecutive documents, sorted by ``doc_id``:

======================  =======================================================
header                  ``HEADER``: magic, bytes of an id, partition, number in it, documents, ids,
                        documents without doc_id, bytes of the two tables below
document ids            Elias-Fano (null ids come first and are only counted)
boundaries              Elias-Fano over the ``documents + 1`` offsets into the ids
ids                     little-endian unsigned 16 or 32 bit
======================  =======================================================

``EliasFano`` keeps about ``2 + log2(universe / n)`` bits per value. ``select`` starts at the bit
position kept for every ``SAMPLE``-th value and skips bytes by popcount, so a reader seeks a
document without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm.subwords import encoder
from claimspark.session import scratch_path, stage

MAGIC = b"EFTOKEN1"
HEADER = struct.Struct("<8sIIIQQQQQ")
SEGMENT_IDS = 1 << 21
SAMPLE = 256
DOCUMENT_SCHEMA = "doc_id long, part int, segment int, first long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    HEAD = struct.Struct("<QqBQQ")

    def __init__(self, n: int, base: int, shift: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.shift = n, base, shift
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, base = len(values), int(values[0]) if len(values) else 0
        above = values.view(np.uint64) - values[:1].view(np.uint64)  # wraps, so any longs fit
        universe = int(above[-1]) if n else 0
        shift = max(0, (universe // max(n, 1)).bit_length() - 1)
        bits = (above[:, None] >> np.arange(shift, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (above >> np.uint64(shift)).astype(np.int64) + np.arange(n)
        high = np.zeros(n + (universe >> shift) + 1, np.uint8)
        high[ones] = 1
        return cls(n, base, shift, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = self.HEAD.pack(self.n, self.base, self.shift, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, base, shift, low, high = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        lows = np.frombuffer(data, np.uint8, low, at)
        highs = np.frombuffer(data, np.uint8, high, at + low)
        return cls(n, base, shift, lows, highs, np.frombuffer(data, "<u4", -(-n // SAMPLE), at + low + high))

    def _lows(self, start: int, count: int) -> np.ndarray:
        if not self.shift:
            return np.zeros(count, np.uint64)
        first, last = start * self.shift, (start + count) * self.shift
        bits = np.unpackbits(self.low[first // 8 : -(-last // 8)], bitorder="little")
        bits = bits[first % 8 :][: count * self.shift].reshape(count, self.shift).astype(np.uint64)
        return (bits << np.arange(self.shift, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def _join(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        above = (high.astype(np.uint64) << np.uint64(self.shift)) | low
        return (above + np.array([self.base], np.int64).view(np.uint64)).view(np.int64)

    def select(self, i: int) -> int:
        """The ``i``-th value: from its sample on, skip whole bytes by popcount."""
        bit, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = bit // 8
        left += int(np.bitwise_count(self.high[byte] & np.uint8((1 << bit % 8) - 1)))
        while left >= (ones := int(np.bitwise_count(self.high[byte]))):
            left, byte = left - ones, byte + 1
        inside = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        return int(self._join(np.array([byte * 8 + inside[left] - i]), self._lows(i, 1))[0])

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return self._join(ones - np.arange(self.n), self._lows(0, self.n))


def pack_segment(part: int, number: int, doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """One segment; ``doc_ids`` ascend, nulls first."""
    sizes = np.array([len(x) for x in ids], np.int64)
    known = [d for d in doc_ids if d is not None]
    names = EliasFano.of(np.array(known, np.int64)).to_bytes()
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(sizes)])).to_bytes()
    flat = np.concatenate(ids).astype(f"<u{width}") if ids else np.zeros(0, f"<u{width}")
    head = HEADER.pack(
        MAGIC, width, part, number, len(sizes), len(flat), len(sizes) - len(known), len(names), len(bounds)
    )
    return head + names + bounds + flat.tobytes()


class Segment:
    """Random access to the documents of one segment."""

    def __init__(self, data: bytes, at: int = 0):
        head = HEADER.unpack_from(data, at)
        magic, self.width, self.part, self.number, self.documents, n_ids, self.nulls, names, bounds = head
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        at += HEADER.size
        self.names = EliasFano.from_bytes(data[at : at + names])
        at += names
        self.bounds = EliasFano.from_bytes(data[at : at + bounds])
        at += bounds
        self.ids = np.frombuffer(data, f"<u{self.width}", n_ids, at)
        self.end = at + n_ids * self.width

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + self.names.values().tolist()


def segments(content: bytes) -> Iterator[Segment]:
    at = 0
    while at < len(content):
        segment = Segment(content, at)
        yield segment
        at = segment.end + 1  # the line feed after each row


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 2) -> None:
    """Encode ``text`` and write token files in ascending ``doc_id`` order, ``end_id`` after each document.

    Texts cross one range shuffle; ids never do. Null texts are empty documents, null ``doc_id``
    come first, rows of one ``doc_id`` are all kept (ordered by text), other columns are ignored.
    ``width`` is the bytes of an id, 2 or 4; an id that does not fit raises.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, names, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"value": [pack_segment(part, number, names, ids, width)]})

        for frame in frames:
            doc_ids = [None if pd.isna(d) else int(d) for d in frame["doc_id"]]
            for i, own in encoder(tokenizer).encode([None if pd.isna(t) else t for t in frame["text"]]):
                if len(own) and int(own.max()) >> (8 * width):
                    raise ValueError(f"an id does not fit into {width} bytes")
                names.append(doc_ids[i])
                ids.append(np.append(own, np.uint32(end_id)).astype(f"<u{width}"))
                held += len(ids[-1])
                if held >= SEGMENT_IDS:
                    yield flush()
                    number, names, ids, held = number + 1, [], [], 0
        if names:
            yield flush()

    order = F.col("doc_id").asc_nulls_first()
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(order)
    # As a string, so that pandas cannot turn a large id into a float beside a null.
    rows = rows.sortWithinPartitions(order, "text").select(F.col("doc_id").cast("string"), "text")
    blobs = rows.mapInPandas(pack, "value binary")
    # The text sink writes the bytes of a row as they are, through any file system Spark knows.
    blobs.select(F.col("value").cast("string")).write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``, from the files alone.

    ``start`` counts the ids of all documents before it; only one row per segment is summed up
    across the files. An empty folder gives no rows.
    """

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                for s in segments(content):
                    bounds = s.bounds.values()
                    wide = s.ids.astype("<u4")
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                    columns = {"part": s.part, "segment": s.number, "first": bounds[:-1]}
                    doc_ids = pd.array(s.doc_ids(), dtype="Int64")
                    yield pd.DataFrame({"doc_id": doc_ids, **columns, "n_tokens": np.diff(bounds), "ids_crc32": crc})

    files = spark.read.format("binaryFile").load(path).select("content")
    found = stage(files.mapInPandas(unpack, DOCUMENT_SCHEMA), "tokens")
    totals = found.groupBy("part", "segment").agg(F.sum("n_tokens").alias("_ids"))
    earlier = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("_base", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)))
    return found.join(bases, ["part", "segment"]).select(
        "doc_id", (F.col("_base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id, width)
    return read_documents(docs.sparkSession, path)
