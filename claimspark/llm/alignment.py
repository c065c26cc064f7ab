"""Alignment of two tokenizers over the same bytes of every text.

Side A is a byte-level BPE file of the ``tokenizers`` library over a blank and the text, side B a
sentencepiece model over the text, which adds the blank itself. Both sides cut the same bytes, so
two tokens overlap exactly when one's start lies inside the other: two as-of joins, keyed by
document, find the covering token of every start, and their union has every link once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.session import scratch_path, stage

# The split pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that are aligned at once, unless one text is longer.
CHUNK_CHARS = 1_000_000
#: Runs of non-space characters above this go to the library's own encoder, which stays fast there.
LONG_RUN = 2_000
#: Pairs of ids with at least ``1 / HOT_PAIRS`` of all links, so at most that many, are broadcast.
HOT_PAIRS = 200_000

STAGED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
        ("groups_sha256", pa.string()),
        ("pairs", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int32())),
    ]
)


def byte_alphabet() -> dict[str, int]:
    """Byte-level letters: printable Latin-1 stands for itself, the other bytes follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(others)}}


class ByteSide:
    """Byte-level BPE ids without special tokens; their strings are plain text.

    The merges run in ``tiktoken``, whose ranks are the file's ids; a text with a very long run
    of non-space characters goes through ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters, special = byte_alphabet(), {t["id"] for t in content["added_tokens"]}
        vocabulary = {i: t for t, i in content["model"]["vocab"].items() if i not in special}
        ranks = {bytes(letters[c] for c in t): i for i, t in vocabulary.items()}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        self.bytes = [b""] * (1 + max(vocabulary))
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, text: str) -> list[int]:
        spaced = " " + text
        if len(text) > LONG_RUN and max(map(len, text.split()), default=len(text)) > LONG_RUN:
            return self.exact.encode(spaced, add_special_tokens=False).ids
        return self.fast.encode_ordinary(spaced)


class PieceSide:
    """Sentencepiece ids; a piece's bytes are its UTF-8 with the mark as a blank, or the byte it names."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [
            bytes([int(name[3:-1], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def covering(starts: np.ndarray, docs: np.ndarray, others: np.ndarray, other_docs: np.ndarray) -> np.ndarray:
    """The position of the other side's token that covers each start, within the same document."""
    left = pd.DataFrame({"at": starts, "doc": docs})
    right = pd.DataFrame({"at": others, "doc": other_docs, "token": np.arange(len(others))})
    return pd.merge_asof(left, right, on="at", by="doc")["token"].to_numpy(np.int64)


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteSide(byte_path), PieceSide(piece_path)
        self.sizes = [np.array([len(t) for t in side.bytes], np.int64) for side in (self.a, self.b)]
        self.wide = max(len(self.a.bytes), len(self.b.bytes))
        # One string per id and what stands before it: a comma, a new group, the other side, nothing.
        self.written = [mark + str(i) for mark in (",", ";", "|", "") for i in range(self.wide)]

    def _sides(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides, empty for a text whose bytes they do not keep."""
        a, b = [], []
        for text in texts:
            own, other = (self.a.encode(text), self.b.encode(text)) if text else ([], [])
            want = (" " + text).encode()
            if any(b"".join(map(s.bytes.__getitem__, ids)) != want for s, ids in ((self.a, own), (self.b, other))):
                own, other = [], []
            a.append(own)
            b.append(other)
        return a, b

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """Counts, group digests and linked id pairs of each text; ``pairs`` are ``a * len(B) + b``."""
        sides, n = self._sides(texts), len(texts)
        ids, doc, ends, starts = [], [], [], []
        for side, size in zip(sides, self.sizes):
            counts = np.array([len(x) for x in side], np.int64)
            flat = np.fromiter(chain.from_iterable(side), np.int64, counts.sum())
            end = np.cumsum(size[flat])  # over the joined bytes of all texts, which both sides share
            ids.append(flat)
            doc.append(np.repeat(np.arange(n), counts))
            ends.append(end)
            starts.append(end - size[flat])
        over = covering(starts[0], doc[0], starts[1], doc[1])
        under = covering(starts[1], doc[1], starts[0], doc[0])
        inner = np.flatnonzero(starts[0][under] != starts[1])  # equal starts are in the first join
        link_a = np.concatenate([np.arange(len(over)), under[inner]])
        link_b = np.concatenate([over, inner])
        link_doc = doc[0][link_a]
        pair = ids[0][link_a] * len(self.b.bytes) + ids[1][link_b]
        order = np.lexsort((pair, link_doc))
        pair, link_doc = pair[order], link_doc[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (link_doc[1:] != link_doc[:-1])
        first = np.flatnonzero(new)

        cuts = np.intersect1d(ends[0], ends[1], assume_unique=True)
        until = [np.searchsorted(e, cuts, "right") for e in ends]  # tokens up to and with each group
        group = [np.searchsorted(cuts, e) for e in ends]
        before = np.concatenate([[0], until[1]])[group[0]]
        place = [np.arange(len(ids[0])) + before, np.arange(len(ids[1])) + until[0][group[1]]]
        codes = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for side, (mark, other) in enumerate(((1, 0), (2, 0))):
            lead = np.ones(len(ids[side]), bool)
            lead[1:] = group[side][1:] != group[side][:-1]
            kind = np.where(lead, mark, other)
            if side == 0:
                begins = np.ones(len(kind), bool)
                begins[1:] = doc[0][1:] != doc[0][:-1]
                kind[begins] = 3
            codes[place[side]] = kind * self.wide + ids[side]
        n_a, n_b = (np.bincount(d, minlength=n) for d in doc)
        bounds = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        words = list(map(self.written.__getitem__, codes.tolist()))
        digests = [
            hashlib.sha256("".join(words[x:y]).encode()).hexdigest() if x < y else "" for x, y in zip(bounds, bounds[1:])
        ]
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(doc[0][np.searchsorted(ends[0], cuts)], minlength=n),
            "n_links": np.bincount(link_doc, minlength=n),
            "groups_sha256": digests,
            "pairs": pair[first],
            "times": np.diff(np.append(first, len(pair))).astype(np.int32),
            "offsets": np.concatenate([[0], np.cumsum(np.bincount(link_doc[first], minlength=n))]).astype(np.int32),
        }


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """The worker's aligner, kept from task to task."""
    return Aligner(byte_path, piece_path)


def linked_texts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per row of ``docs`` its counts, its group digest and its distinct id pairs with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            done = 0
            while done < len(texts):
                upto, chars = done, 0
                while upto < len(texts) and (upto == done or chars + len(texts[upto]) <= CHUNK_CHARS):
                    chars += len(texts[upto])
                    upto += 1
                found = aligner(byte_path, piece_path).align(texts[done:upto])
                at = pa.array(found["offsets"], pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(found[c])) for c in ("pairs", "times")]
                counts = [pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                own = names.slice(done, upto - done)
                yield pa.RecordBatch.from_arrays([own, *counts, pa.array(found["groups_sha256"]), *lists], schema=ARROW)
                done = upto

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, STAGED)


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """``(pair, total, best)``: links of each id pair over all texts, and whether its B id has none with more."""
    counts = stage(links.groupBy("pair").agg(F.sum("n").alias("total")), "pair-counts")
    counts = counts.withColumn("_b", F.col("pair") % n_b)
    most = counts.groupBy("_b").agg(F.max("total").alias("_most"))  # at most one row per B id: n_b rows
    joined = counts.join(F.broadcast(most), "_b")
    return joined.select("pair", "total", (F.col("total") == F.col("_most")).alias("best"))


def aligned_documents(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``docs``.

    A text that is null or empty, or whose bytes either side does not give back, has zeros and an
    empty ``groups_sha256``. Rows of one ``doc_id`` (null included) are aligned each, other columns
    are ignored whatever their names, an empty table gives no rows, a text of any length is
    aligned whole. Texts are encoded once; the pairs of each are staged, counted over all texts,
    and looked up again: the few frequent ones by broadcast, the others by a join on the pair.
    """
    n_b = len(PieceSide(piece_path).bytes)
    path = scratch_path(docs.sparkSession, "linked-texts")
    rows = linked_texts(docs, byte_path, piece_path).withColumn("row", F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(path)
    rows = docs.sparkSession.read.schema(rows.schema).parquet(path)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    links = links.select("row", F.col("link.pairs").alias("pair"), F.col("link.times").cast("long").alias("n"))
    counts = stage(pair_counts(links, n_b), "pair-totals")
    least = F.lit((counts.agg(F.sum("total")).first()[0] or 0) / HOT_PAIRS)
    hot = F.broadcast(counts.filter(F.col("total") >= least))
    known = links.join(hot, "pair", "left")
    rare = known.filter(F.col("total").isNull()).select("row", "pair", "n")
    rare = rare.join(counts.filter(F.col("total") < least), "pair")
    sums = [
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("total")).alias("count_sum"),
    ]
    # A document's links lie in one task, so each branch passes on few rows per document.
    both = known.filter("total is not null").groupBy("row").agg(*sums).unionByName(rare.groupBy("row").agg(*sums))
    totals = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(totals, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
