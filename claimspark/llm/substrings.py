"""Removal of repeated passages, found by fixed-block anchors.

Any window of ``window`` words holds a whole block of ``(window + 1) // 2`` words that starts at a
multiple of that length. Those blocks are the reference; every rolling block of every text probes
them. A reference block that some other position holds too is a hit, and each hit is extended to
the windows around it, which are compared in full. Both places of a repeated window are found this
way, as each holds a hit block of its own; overlapping windows add up to the maximal repeats.

Probes cross the shuffle as four bytes a word, once per chunk of texts, in buckets of bounded size; a
wrong hit among them only costs an extension. Windows are compared by 128 bits, also in buckets: a
chunk sends each hash once and gets one bit back for it, in the order sent. Only texts that hold a
hit, as a bitmap of their marks tells, move to be extended, and only those with a repeat to be cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.session import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Probes of one bucket, about.
BUCKET_PROBES = 1 << 20
CACHE_WORDS = 500_000
#: Words of texts that are probed together.
CHUNK_WORDS = 1 << 20
#: Bits that tell which texts hold a hit.
BITMAP = 1 << 26
#: A reference block on its way: the low bits of its hash, its number and the mark of its text.
REF = np.dtype([("low", "<u4"), ("block", "<u4"), ("mark", "<i8")])
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_known: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes; a worker keeps those of words it has seen."""
    new = set(words).difference(_known)
    if len(_known) > CACHE_WORDS:
        _known.clear()
        new = set(words)
    _known.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """One hash per start of ``size`` consecutive words; position matters, ends are mixed.

    Sums of powers of two lengths are doubled, so the work grows with the logarithm of ``size``.
    """
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    value, done, part, length, power = None, 0, hashes, 1, base
    while True:
        if size & length:
            if value is None:
                value = part
            else:
                room = len(hashes) - done - length + 1
                value = value[:room] * np.uint64(power) + part[done : done + room]
            done += length
        if done == size:
            break
        room = len(hashes) - 2 * length + 1
        part = part[:room] * np.uint64(power) + part[length : length + room]
        power, length = power * power % (1 << 64), 2 * length
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(32))


def _texts(frame: pd.DataFrame) -> list[str]:
    return [t if isinstance(t, str) else "" for t in frame["text"]]


def _runs(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end positions of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(order))


def _dealt(bucket: np.ndarray, values: np.ndarray) -> dict[int, bytes]:
    """The values of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    bucket, values = bucket[order], values[order]
    return {int(bucket[a]): values[a:b].tobytes() for a, b in zip(*_runs(bucket))}


def _hits(docs: DataFrame, block: int, buckets: int) -> DataFrame:
    """``mark, block``: the reference blocks of each text that occur at least twice."""

    def flush(held: list, marks: list, turn: int) -> pd.DataFrame:
        hashes, refs = np.concatenate(held), np.zeros(sum(-(-len(h) // block) for h in held), REF)
        whole = np.concatenate([h[::block] for h in held])
        sizes = [-(-len(h) // block) for h in held]
        refs["low"], refs["mark"] = whole.astype(np.uint32), np.repeat(np.array(marks, np.int64), sizes)
        refs["block"] = np.concatenate([np.arange(n) for n in sizes])
        found, counts = np.unique(hashes, return_counts=True)
        # A block that the chunk itself holds twice is a hit already, however common it is.
        sure = counts[np.searchsorted(found, whole)] > 1
        sent = np.concatenate([found, found[counts > 1]])
        bucket = lambda h: ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        probes, asked = _dealt(bucket(sent), sent.astype(np.uint32)), _dealt(bucket(whole[~sure]), refs[~sure])
        rows = [(name, own, asked.get(name, b""), b"") for name, own in probes.items()]
        rows.append((turn % buckets, b"", b"", refs[sure].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "probes", "refs", "sure"])

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, marks, words, turn = [], [], 0, 7919 * TaskContext.get().partitionId()
        for frame in frames:
            for mark, text in zip(frame["mark"], _texts(frame)):
                hashed = rolling(word_hashes(WORD.findall(text)), block)
                if len(hashed):
                    held.append(hashed)
                    marks.append(mark)
                    words += len(hashed)
                if words > CHUNK_WORDS:
                    yield flush(held, marks, turn)
                    held, marks, words, turn = [], [], 0, turn + 1
        if held:
            yield flush(held, marks, turn)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        found, counts = np.unique(np.frombuffer(b"".join(frame["probes"]), np.uint32), return_counts=True)
        refs = np.frombuffer(b"".join(frame["refs"]), REF)
        hits = refs[counts[np.searchsorted(found, refs["low"])] > 1] if len(refs) else refs
        hits = np.concatenate([hits, np.frombuffer(b"".join(frame["sure"]), REF)])
        return pd.DataFrame({"mark": hits["mark"], "block": hits["block"].astype(np.int64)})

    sent = docs.select("mark", "text").mapInPandas(probe, "bucket long, probes binary, refs binary, sure binary")
    return sent.groupBy("bucket").applyInPandas(meet, "mark long, block long")


def _repeated(near: DataFrame, window: int, block: int, buckets: int) -> DataFrame:
    """``key, runs``: of texts with the ``blocks`` of their hits, the runs of starts of repeated windows.

    A chunk keeps a record of its windows and sends their hashes to buckets; what it holds twice itself
    needs no answer. Buckets answer by one bit per hash, and the record turns the bits into runs.
    """
    slot = np.uint16 if buckets < 0xFFFF else np.uint32
    own = np.iinfo(slot).max  # repeated within the chunk

    def flush(held: list, chunk: int) -> pd.DataFrame:
        starts = np.concatenate([h[1] for h in held])
        owner = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        hashes = np.concatenate([h[2] for h in held])
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        same = (hashes[order[1:]] == hashes[order[:-1]]).all(axis=1)
        many = np.zeros(len(order), bool)
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
        first = order[np.concatenate([[True], ~same])]
        first = first[many[first]]
        bucket = ((hashes[:, 0] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        once, twice = _dealt(bucket[~many], hashes[~many]), _dealt(bucket[first], hashes[first])
        rows = [(name, chunk, once.get(name, b""), twice.get(name, b""), None, None, None) for name in {*once, *twice}]
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(owner) != 0)]))
        runs = np.stack([owner[begin], starts[begin], np.diff(np.append(begin, len(starts)))], axis=1).astype(np.int64)
        slots = np.where(many, own, bucket).astype(slot)
        rows.append((-1 - chunk, chunk, b"", b"", b"".join(h[0] for h in held), runs.tobytes(), slots.tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "once", "twice", "keys", "runs", "slots"])

    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting, chunk = [], 0, TaskContext.get().partitionId() << 32
        for frame in frames:
            for key, text, hit in zip(frame["key"], _texts(frame), frame["blocks"]):
                hashed = word_hashes(WORD.findall(text))
                last = len(hashed) - window
                hit = np.asarray(hit, np.int64)[:, None] * block
                starts = np.unique(hit - np.arange(window - block + 1))
                starts = starts[(starts >= 0) & (starts <= last)]
                if not len(starts):
                    continue
                held.append((bytes(key), starts, np.stack([rolling(hashed, window, base)[starts] for base in BASES], axis=1)))
                waiting += len(starts)
                if waiting > CHUNK_WORDS:
                    yield flush(held, chunk)
                    held, waiting, chunk = [], 0, chunk + 1
        if held:
            yield flush(held, chunk)

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["bucket"].iloc[0] < 0:
            return frame.assign(bits=None)[["bucket", "chunk", "bits", "keys", "runs", "slots"]]
        asked = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in frame["once"]]
        known = np.frombuffer(b"".join(frame["twice"]), np.uint64).reshape(-1, 2)
        hashes = np.concatenate([*asked, known, known])
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        same = (hashes[order[1:]] == hashes[order[:-1]]).all(axis=1)
        again = np.zeros(len(order), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        ends = np.cumsum([len(x) for x in asked])
        bits = [np.packbits(x).tobytes() for x in np.split(again[: ends[-1]], ends[:-1])]
        return frame[["bucket", "chunk"]].assign(bits=bits, keys=None, runs=None, slots=None)

    def decode(frame: pd.DataFrame) -> pd.DataFrame:
        record = frame[frame["bucket"] < 0].iloc[0]
        slots, keys = np.frombuffer(record["slots"], slot), record["keys"]
        repeated = slots == own
        asked = np.flatnonzero(~repeated)
        asked = asked[np.argsort(slots[asked], kind="stable")]
        bits = {b: x for b, x in zip(frame["bucket"], frame["bits"]) if b >= 0}
        for a, b in zip(*_runs(slots[asked])):
            answered = np.frombuffer(bits[int(slots[asked[a]])], np.uint8)
            repeated[asked[a:b]] = np.unpackbits(answered, count=b - a).astype(bool)
        runs = np.frombuffer(record["runs"], np.int64).reshape(-1, 3)
        owner = np.repeat(runs[:, 0], runs[:, 2])
        begin = np.cumsum(runs[:, 2]) - runs[:, 2]
        starts = np.arange(len(slots)) + np.repeat(runs[:, 1] - begin, runs[:, 2])
        owner, starts = owner[repeated], starts[repeated]
        if not len(owner):
            return pd.DataFrame({"key": [], "runs": []})
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(owner) != 0)]))
        spans = np.stack([starts[begin], starts[np.append(begin[1:], len(starts)) - 1]], axis=1).astype(np.int64)
        owner = owner[begin]
        out = [(keys[16 * owner[a] : 16 * owner[a] + 16], spans[a:b].tobytes()) for a, b in zip(*_runs(owner))]
        return pd.DataFrame(out, columns=["key", "runs"])

    record = "keys binary, runs binary, slots binary"
    sent = near.mapInPandas(extend, f"bucket long, chunk long, once binary, twice binary, {record}")
    answers = sent.groupBy("bucket").applyInPandas(answer, f"bucket long, chunk long, bits binary, {record}")
    return answers.groupBy("chunk").applyInPandas(decode, "key binary, runs binary")


def _marked(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Add ``_maybe``: false only for rows whose ``key`` is not in ``found``.

    A bitmap of at most ``BITMAP`` bits, in rows of 32,768, is broadcast; a bit set by another key costs a join.
    """
    spot = F.pmod(F.xxhash64(key), F.lit(BITMAP))
    bits = found.select(spot.alias("_spot")).groupBy(F.bitmap_bucket_number("_spot").alias("_at"))
    bits = stage(bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits")), "bitmap")
    place = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), place % 8)), F.lit(2)) == 1
    placed = rows.withColumn("_at", F.bitmap_bucket_number(spot)).join(F.broadcast(bits), "_at", "left")
    return placed.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_at", "_bits")


def covered_words(docs: DataFrame, window: int) -> DataFrame:
    """``key, runs``: first and last starts of the runs of repeated windows, for texts that hold any.

    ``docs`` has ``key``, 16 bytes that tell rows apart as far as their id and text do, and ``text``.
    """
    block = (window + 1) // 2
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(1, chars // (6 * BUCKET_PROBES))  # words have about six characters with their space
    docs = docs.select("key", "text", F.xxhash64("key").alias("mark"))
    hits = stage(_hits(docs, block, buckets), "hits")
    windows = hits.count() * (window - block + 1)
    blocks = hits.groupBy("mark").agg(F.collect_set("block").alias("blocks"))
    near = _marked(docs, hits, "mark").filter("_maybe").drop("_maybe")
    near = near.hint("merge").join(blocks, "mark").select("key", "text", "blocks")
    found = _repeated(near, window, block, max(1, windows // BUCKET_PROBES))
    return stage(found.groupBy("key").agg(F.first("runs").alias("runs")), "repeated")  # equal rows have equal runs


def _kept(text: str, runs, window: int) -> tuple[list[str], int]:
    words = WORD.findall(text)
    if runs is None or not len(runs):
        return words, 0
    change = np.zeros(len(words) + 1, np.int64)
    runs = np.frombuffer(runs, np.int64).reshape(-1, 2)
    change[runs[:, 0]] += 1
    change[runs[:, 1] + window] -= 1
    inside = np.cumsum(change)[:-1] > 0
    return [w for w, gone in zip(words, inside.tolist()) if not gone], int(inside.sum())


def with_cuts(docs: DataFrame, window: int = 35) -> DataFrame:
    """Every column of ``docs`` and the struct ``cuts``: ``n_words, n_removed, kept_sha256, kept``.

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in the
    same text or another; all copies go. ``kept`` is the rest, joined by single spaces. Null and
    empty texts have no words. Equal rows are rows of their own, so their long passages go. A column
    ``cuts`` is replaced, and an empty table gives no rows.
    """
    text, own = F.col("text").cast("string"), [c for c in docs.columns if c != "cuts"]
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    key = F.substring(F.unhex(F.sha2(named, 256)), 1, 16)
    rows = docs.select(F.struct(*own).alias("row"), text.alias("text"), key.alias("key"))
    found = covered_words(rows.select("key", "text"), window)

    def cut(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, runs in frames:
            out = []
            for own, at in zip(_texts({"text": texts}), runs):
                kept, removed = _kept(own, at, window)
                joined = " ".join(kept)
                digest = hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((len(kept) + removed, removed, digest, joined))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept"])

    cuts = F.pandas_udf(cut, "n_words long, n_removed long, kept_sha256 string, kept string")
    rows = _marked(rows.select("row", "key"), found, "key")
    cut_rows = rows.filter("_maybe").hint("merge").join(found, "key", "left").select("row", "runs")
    whole = rows.filter("not _maybe").select("row", F.lit(None).cast("binary").alias("runs"))
    return cut_rows.unionByName(whole).select("row", cuts("row.text", "runs").alias("cuts")).select("row.*", "cuts")


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; texts without any stay as they are."""
    cut = F.col("cuts.n_removed") > 0
    rows = with_cuts(docs, window).withColumn("text", F.when(cut, F.col("cuts.kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)
