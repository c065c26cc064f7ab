"""N-gram Jaccard join by token-combination prefixes.

A document is its set of hashed word shingles, rare ones first: a histogram of all shingles over
``BUCKETS`` hash buckets, counted over every row, tells the frequent ones, and any order that is the
same for all sets is right. Two sets of sizes ``n`` and ``m`` that link miss at most
``e = n - ceil(t n)`` of each other's tokens, so prefixes of ``e + j`` tokens share ``j``. Tokens that
many prefixes hold are dealt into ``N`` classes by their hash, where combinations of ``k`` tokens of
one class are indexed; the others are indexed singly. With ``j = (k - 1) N + 1`` either a single
token is shared or some class has ``k`` shared ones; so two linked sets share a key. ``N`` depends on
the size only, and a set is indexed for the sizes its partners may have.

``k`` starts at 2. Sets of a key that would still give more than ``PARTNERS`` pairs a set extend their
prefixes by ``N`` and are indexed by ``k + 1`` tokens, among themselves only: two that link share such
a key again, as both are among them. Pairs of the other keys are compared, and those of all keys at
``LONGEST``. Two sets share all combinations of the tokens they share in a class; at ``LONGEST``, where each has many, they are
paired at the first one only, which both tell by the tokens it skips.

Equal sets are one class before anything is compared. A key's sets are compared with two leaders
of different components first; after that only sets of different components are, so a group of near
copies never yields all its pairs, and no link that could join two components is left out.

Only prefixes and parity sketches are written. A sketch has about one bit per token, flipped by each
token that falls on it; two sets differ in at least as many tokens as their sketches do in bits. The
full sets are made again from the texts, and only for pairs whose sketches may link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from claimspark.llm.substrings import rolling
from claimspark.session import stage

#: A token in more prefixes than this is indexed in combinations.
FREQUENT = 24
#: Pairs a set that a key may give before its sets are indexed by longer combinations.
PARTNERS = 16
#: Tokens of the longest combinations.
LONGEST = 4
#: Sets of a cluster whose sketches are compared together, about, and words of sketches held at once.
BLOCK_SETS, BLOCK_WORDS = 512, 1 << 20
#: Bits per token of the sketches compared so, times those of the others.
WIDER = 4
#: Counters of the histogram of all tokens.
BUCKETS = 1 << 18
#: Bytes of texts whose words are hashed together, and those of a word beyond which it is hashed alone.
BLOCK, LONG = 1 << 17, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = 0x9E3779B97F4A7C1B
VISIBLE = np.array([i != 0x20 and not 0x09 <= i <= 0x0D for i in range(256)])
#: A number per byte, the same for A-Z and a-z.
CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 64, 256, np.uint64)
CODES[ord("A") : ord("Z") + 1] = CODES[ord("a") : ord("z") + 1]


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``2 ** bits`` powers of ``BASE`` and of its inverse, modulo 2 ** 64."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        factors = np.full(1 << bits, base, np.uint64)
        factors[0] = 1
        both.append(np.cumprod(factors))
    return both[0], both[1]


def _hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word: a sum over its bytes, as a difference of running sums, mixed."""
    hashes, firsts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        cut = data.rfind(b" ", at, at + BLOCK) + 1 if len(data) - at > BLOCK else len(data)
        cut = cut or data.find(b" ", at + BLOCK) + 1 or len(data)
        codes = np.frombuffer(data, np.uint8, cut - at, at)
        seen = np.zeros(len(codes) + 2, bool)
        seen[1:-1] = VISIBLE[codes]
        edges = np.flatnonzero(seen[1:] != seen[:-1])
        first, end = edges[::2], edges[1::2]
        powers, inverse = _powers((max(BLOCK, len(codes)) - 1).bit_length())
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(CODES[codes] * powers[: len(codes)], out=sums[1:])
        value = (sums[end] - sums[first]) * inverse[first]
        value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        for i in np.flatnonzero(end - first > LONG).tolist():
            value[i] = xxhash.xxh64_intdigest(data[at + first[i] : at + end[i]].lower())
        hashes.append(value)
        firsts.append(first + at)
        at = cut
    return np.concatenate(hashes), np.concatenate(firsts)


def shingle_sets(texts: Iterable[bytes | None], words: int) -> Iterator[np.ndarray]:
    """Per text its sorted distinct hashes of ``words`` consecutive words; fewer words are one shingle.

    A-Z are lower-cased; words are cut at ASCII white space. Texts are hashed about ``BLOCK`` bytes at a time.
    """
    held, size = [], 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1]) + 1
        if size >= BLOCK:
            yield from _sets(held, words)
            held, size = [], 0
    if held:
        yield from _sets(held, words)


def _sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    hashes, firsts = _hashed_words(b" ".join(texts))
    bounds = np.searchsorted(firsts, np.cumsum([0] + [len(t) + 1 for t in texts])).tolist()
    found = rolling(hashes, words)
    for a, b in zip(bounds, bounds[1:]):
        own = np.sort(found[a : b - words + 1] if b - a >= words else rolling(hashes[a:b], max(1, b - a)))
        first = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=first[1:])
        yield own[first]


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def token_levels(docs: DataFrame, words: int, frequent: int) -> np.ndarray:
    """For each bucket 0, or about the log2 of how often its tokens occur beyond an even share."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for frame in frames:
            found = [*shingle_sets(frame["text"], words), np.zeros(0, np.uint64)]
            total += np.bincount(_bucket(np.concatenate(found)), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    counts = texts.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS)
    total[counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy()
    mean = total.mean()
    beyond = total - mean
    return np.where(beyond > 8 * np.sqrt(mean) + frequent, 1 + np.log2(np.maximum(beyond, 1)), 0).astype(np.uint8)


def _ranked(texts: Iterable[bytes | None], words: int, levels: np.ndarray) -> Iterator[np.ndarray]:
    """The shingles of each text, those of low levels first."""
    for tokens in shingle_sets(texts, words):
        yield tokens[np.argsort(levels[_bucket(tokens)], kind="stable")].view(np.int64)


def ranked_sets(words: int, levels: np.ndarray) -> Callable[[Column], Column]:
    """A function of a binary text: all its tokens, in order."""

    @F.pandas_udf(ArrayType(LongType()))
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_ranked(texts, words, levels)))

    return tokens


def set_summaries(words: int, levels: np.ndarray, percent: int, k: int = 2) -> Callable[[Column], Column]:
    """A function of a binary text: size, digest, prefix and parity sketch of its set.

    Sets that link with equal ones only have neither prefix nor sketch.
    """
    smallest = percent // max(1, 100 - percent) if percent < 100 else 1 << 30
    wider = WIDER if k == LONGEST else 1

    @F.pandas_udf("n int, digest binary, prefix array<bigint>, parity array<bigint>")
    def summary(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for tokens in _ranked(texts, words, levels):
            n, digest = len(tokens), hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
            some = n >= smallest
            rows.append((n, digest, tokens[: prefix_length(n, percent, k)] if some else None, parity(tokens, wider) if some else None))
        return pd.DataFrame(rows, columns=["n", "digest", "prefix", "parity"])

    return summary


def parity(tokens: np.ndarray, wider: int = 1) -> np.ndarray:
    """Sketch of a set: a power of two of bits, at least ``wider`` (one as well) per token, as 64-bit words."""
    bits = max(64, wider << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount(tokens & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix_length(n: int, percent: int, k: int = 2) -> int:
    """Tokens of a set of ``n`` that any set it links with may be looked up by, ``k`` at a time."""
    classes = max(1, 1 << max(0, (n * 100 // percent).bit_length() - 5))
    return (k - 1) * classes + n - (n * percent + 99) // 100 + 1


def _classes(n: Column) -> Column:
    """Number of token classes for sets of ``n``: a power of two between n/32 and n/16."""
    return F.greatest(F.lit(1), F.pow(F.lit(2), F.floor(F.log2(n.cast("double"))) - 4).cast("int"))


def _largest(n: Column, percent: int) -> Column:
    return F.floor(n * 100 / percent).cast("int")


def _listed(tokens: Column | None) -> Column:
    return F.array().cast("array<bigint>") if tokens is None else tokens


def _combined(tokens: Column, k: int, seed: Column, skipped: Column | None) -> Column:
    """Hashes of all combinations of ``k`` elements of an array, with what goes ``before`` the last of each.

    ``skipped`` are the tokens up to the last that are left out; None notes none of them.
    """
    passed = lambda i: None if skipped is None else F.concat(skipped, F.transform(F.slice(tokens, 1, i), lambda a: a["token"]))
    if k == 1:
        last = lambda a, i: F.struct(F.xxhash64(seed, a["token"]).alias("key"), a["before"].alias("before"), _listed(passed(i)).alias("skipped"))
        return F.transform(tokens, last)
    more = lambda a, i: _combined(F.slice(tokens, i + 2, F.size(tokens)), k - 1, F.xxhash64(seed, a["token"]), passed(i))
    return F.flatten(F.transform(tokens, more))


def _keys(prefixes: DataFrame, percent: int, frequent: int, k: int) -> DataFrame:
    """``key, id, n, before, skipped``: everything a set is indexed by, ``k`` tokens at a time, and that another set shares.

    Sets that share a token which few prefixes hold meet at its own key. So two sets that need a
    combination to meet share none of the ``before`` such tokens that go before it in either, and a
    set with more of them than it may miss needs no such key.
    """
    n = F.col("n")
    prefix = prefixes.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    counts = prefix.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    known = stage(prefix.hint("merge").join(counts, "token"), "prefix-counts")
    single = known.filter(F.col("df") <= frequent).select(F.col("token").alias("key"), "id", "n", F.lit(0).alias("before"), _listed(None).alias("skipped"))
    held = known.filter(F.col("df") > frequent).groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("held"))
    held = held.select("id", "n", F.posexplode("held").alias("rank", "one"))
    held = held.select("id", "n", "one.*", (F.col("one.pos") - F.col("rank")).alias("before"))
    held = held.filter(F.col("before") <= n - F.floor((n * percent + 99) / 100))
    levels = F.array_distinct(F.array(_classes(n), _classes(_largest(n, percent))))
    dealt = held.withColumn("classes", F.explode(levels))
    dealt = dealt.withColumn("class", F.pmod(F.xxhash64("token"), F.col("classes")))
    own = dealt.groupBy("id", "n", "classes", "class").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "before"))).alias("own"))
    combined = _combined(F.col("own"), k, F.xxhash64(F.lit(k), "classes"), _listed(None) if k == LONGEST else None)
    combined = own.filter(F.size("own") >= k).select("id", "n", F.explode(combined).alias("c")).select("c.key", "id", "n", "c.before", "c.skipped")
    return stage(single.unionByName(combined), "join-keys")


def _may_link(n: str, m: str, before: Column, percent: int) -> Column:
    """Whether sets of these sizes that differ in ``before`` tokens may link."""
    total = F.col(n) + F.col(m)
    return _fits(n, m, percent) & (before <= total - 2 * F.ceil(total * percent / (100 + percent)))


def _fits(n: str, m: str, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that may link, by the sizes and ``parity`` of their sets."""
    left = sketches.select(F.col("id").alias("a"), F.col("n").alias("_n"), F.col("parity").alias("_p"))
    right = sketches.select(F.col("id").alias("b"), F.col("n").alias("_m"), F.col("parity").alias("_q"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    size = F.least(F.size("_p"), F.size("_q"))

    def folded(sketch: str) -> Column:
        """The sketch at the smaller size: words a multiple of it apart are XORed."""
        part = lambda i: F.slice(sketch, i * size + 1, size)
        more = F.expr(f"sequence(1, size({sketch}) div least(size(_p), size(_q)) - 1)")
        xor = lambda x, y: x.bitwiseXOR(y)
        wide = F.aggregate(more, part(F.lit(0)), lambda held, i: F.zip_with(held, part(i), xor))
        return F.when(F.size(sketch) == size, F.col(sketch)).otherwise(wide)

    flips = F.zip_with(folded("_p"), folded("_q"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(flips, F.lit(0), lambda held, x: held + x)
    # shared = (n + m - differ) / 2 at most, and the union is the rest
    total = F.col("_n") + F.col("_m")
    return both.filter((total - differ) * 100 >= (total + differ) * percent).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of set ids whose sets link."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("_y"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    shared = F.size(F.array_intersect("_x", "_y"))
    return both.filter(shared * 100 >= (F.size("_x") + F.size("_y") - shared) * percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable over ``a, b``, for every id in a link.

    Alternating large-star and small-star steps, with the edges written after each round.
    """
    ends = lambda e: e.union(e.select("b", "a"))
    edges = stage(links.select("a", "b").filter("a <> b").distinct(), "links")
    before = None
    while True:
        around = ends(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.filter("b > a").hint("merge").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.hint("merge").join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = stage(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _clusters(crowded: DataFrame) -> DataFrame:
    """``id, cluster, blocks`` of the sets of crowded keys, for clusters with no more pairs than their keys make.

    A cluster holds the sets that keys tie together, in any number of steps.
    """
    tied = stage(crowded.groupBy("key").agg(F.min("id").alias("a"), F.count("*").cast("double").alias("sets")), "tied-keys")
    reached = stage(components(crowded.hint("merge").join(tied, "key").select("a", F.col("id").alias("b"))), "clusters")
    by_key = tied.groupBy(F.col("a").alias("id")).agg(F.sum(F.col("sets") * F.col("sets")).alias("paired"))
    paired = by_key.hint("merge").join(reached, "id").groupBy("component").agg(F.sum("paired").alias("paired"))
    members = reached.groupBy("component").agg(F.count("*").cast("double").alias("members"))
    dense = members.hint("merge").join(paired, "component").filter("members * members <= paired")
    blocks = F.ceil(F.col("members") / BLOCK_SETS).cast("int").alias("blocks")
    return reached.hint("merge").join(dense.select("component", blocks), "component").withColumnRenamed("component", "cluster")


def _folded(sketches: list[np.ndarray], words: int) -> np.ndarray:
    """Sketches of one size at a smaller one: words a multiple of it apart are XORed."""
    return np.bitwise_xor.reduce(np.stack(sketches).view(np.uint64).reshape(len(sketches), -1, words), axis=1)


def _differing(left: list[np.ndarray], right: list[np.ndarray], most: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Places in both lists of the sketches that differ in at most ``most(left, right)`` bits, and in how many."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    for one, other in ((a, b) for a in np.unique(sizes[0]) for b in np.unique(sizes[1]) if max(a, b) <= 2 * min(a, b)):
        rows, columns = np.flatnonzero(sizes[0] == one), np.flatnonzero(sizes[1] == other)
        words = min(one, other)
        x, y = _folded([left[i] for i in rows], words), _folded([right[i] for i in columns], words)
        step = max(1, BLOCK_WORDS // (len(columns) * words))
        for i in range(0, len(rows), step):
            bits = np.bitwise_count(x[i : i + step, None] ^ y[None]).sum(axis=2, dtype=np.int64)
            a, b = np.nonzero(bits <= most(rows[i : i + step, None], columns[None]))
            yield rows[i + a], columns[b], bits[a, b]


def _in_blocks(sets: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """The pairs ``a, b`` of a cluster's sets of different components that may link, by sizes and sketches.

    ``nearest``: only the nearest one of each set, in each block.
    """

    def pairs(held: pd.DataFrame) -> pd.DataFrame:
        one, other = (held[held["block"] == held[c].iat[0]] for c in ("low", "high")) if len(held) else (held, held)
        ids, n, of = ([side[c].to_numpy() for side in (one, other)] for c in ("id", "n", "component"))
        within = len(one) > 0 and held["low"].iat[0] == held["high"].iat[0]

        def most(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            total = n[0][i].astype(np.int64) + n[1][j]
            open_ = (of[0][i] != of[1][j]) & (np.minimum(n[0][i], n[1][j]) * 100 >= np.maximum(n[0][i], n[1][j]) * percent)
            open_ &= (ids[0][i] < ids[1][j]) | (not within)
            return np.where(open_, total * (100 - percent) // (100 + percent), -1)

        found = list(_differing(one["parity"].tolist(), other["parity"].tolist(), most))
        i, j, bits = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        if nearest:
            order = np.lexsort((j, bits))
            kept = [order[np.unique(x[order], return_index=True)[1]] for x in (i, j)]
            kept = np.unique(np.concatenate(kept))
            i, j = i[kept], j[kept]
        a, b = ids[0][i], ids[1][j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    dealt = sets.select("id", "n", "parity", "component", "cluster", "blocks", block)
    dealt = dealt.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).drop("blocks", "with")
    return dealt.groupBy("cluster", "low", "high").applyInPandas(pairs, "a long, b long")


def _linked(
    prefixes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], longer: Callable[[DataFrame, int], DataFrame], percent: int, frequent: int
) -> DataFrame:
    """Enough links between distinct sets to connect every component.

    ``sets_of`` gives ids their sets, ``longer`` their sizes, prefixes for combinations of some length and sketches.
    """
    links, found, now = None, None, prefixes.select("id", "n", "prefix")
    for k in range(2, LONGEST + 1):
        keys = _keys(now, percent, frequent, k)
        tried = _led(_marked(keys, found), percent)
        first = stage(_checked(tried, prefixes, sets_of, percent, "first"), "first-links")
        links = first if links is None else links.unionByName(first)
        found = stage(components(links), "components")
        marked = stage(_marked(keys, found), "open-keys")
        # what comparing all sets of different components would make of each key
        held = marked.groupBy("key", "component").agg(F.count("*").cast("double").alias("c")).groupBy("key")
        held = held.agg(F.sum("c").alias("sets"), F.sum(F.col("c") * F.col("c")).alias("same"))
        crowded = (F.col("sets") * F.col("sets") - F.col("same")) / 2 > PARTNERS * F.col("sets")
        held = held.filter("sets * sets > same").select("key", crowded.alias("crowded"))
        marked = stage(marked.hint("merge").join(held, "key"), "judged-keys")
        few, many = marked.filter("not crowded"), marked.filter("crowded")
        crowd = stage(many.select("id").distinct(), "crowd")
        crowded = not crowd.isEmpty()
        if crowded and k == LONGEST:
            dense = stage(_clusters(many), "dense-sets")
            few = few.unionByName(many.hint("merge").join(dense, "id", "left_anti"))
            dense = dense.hint("merge").join(now.select("id", "n", "parity"), "id")
            for nearest in (True, False):
                found = found if nearest else stage(components(links), "components")
                near = stage(_in_blocks(_marked(dense, found), percent, nearest).join(tried, ["a", "b"], "left_anti"), "block-pairs")
                links = links.unionByName(stage(_compared(near, sets_of, percent, "block"), "block-links"))
        other = few.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("before").alias("more"), F.col("component").alias("other"), F.col("skipped").alias("passed"))
        rest = few.withColumnRenamed("id", "a").hint("merge").join(other, "key")
        fit = _may_link("n", "m", F.col("before") + F.col("more"), percent)
        # Tokens stand in one order in all sets: of the combinations that two share in a class, only the first skips nothing shared.
        first_met = ~F.arrays_overlap("skipped", "passed")
        rest = rest.filter((F.col("a") < F.col("b")) & (F.col("component") != F.col("other")) & fit & first_met)
        rest = rest.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        links = links.unionByName(stage(_checked(rest, prefixes, sets_of, percent, "rest"), "rest-links"))
        if not crowded or k == LONGEST:
            break
        now = stage(longer(crowd, k + 1), "prefixes")
    return links


def _marked(keys: DataFrame, found: DataFrame | None) -> DataFrame:
    """``keys`` with the component of each set; a set without links is its own."""
    if found is None:
        return keys.withColumn("component", F.col("id"))
    return keys.hint("merge").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _led(keys: DataFrame, percent: int) -> DataFrame:
    """Pairs of a key's sets with its two leaders, of the first and the last component."""
    order = F.struct("component", "id", "n", "before")
    leads = keys.groupBy("key").agg(F.min(order).alias("l1"), F.max(order).alias("l2")).filter("l1.component < l2.component")
    leads = leads.select("key", F.explode(F.array("l1", "l2")).alias("lead"))
    fit = _may_link("n", "lead.n", F.col("before") + F.col("lead.before"), percent)
    tried = keys.hint("merge").join(leads, "key").filter((F.col("component") != F.col("lead.component")) & fit)
    return stage(tried.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct(), "led-pairs")


def _checked(pairs: DataFrame, sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, name: str) -> DataFrame:
    """The pairs that link: bounded by sketches, then compared in full."""
    return _compared(stage(possible(pairs, sketches, percent), f"{name}-pairs"), sets_of, percent, name)


def _compared(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, name: str) -> DataFrame:
    """The pairs that link, compared in full."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return verified(pairs, stage(sets_of(ids), f"{name}-sets"), percent)


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``.

    Rows link when ``100 * intersection >= percent * union`` of their sets of ``words``-word
    shingles (A-Z lower-cased). ``component_id`` is the smallest ``doc_id`` reachable by links. Null
    texts and texts without words have no shingles and link with nothing, themselves included; a
    null ``doc_id`` takes part in links and is named only where its component has no other. Rows of
    one ``doc_id`` are kept each. Other columns are ignored; an empty table gives no rows.
    """
    found, rows = _row_components(docs, words, percent, frequent)
    joined = found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    bare = rows.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(bare)


def _source() -> Column:
    """Names a row by its id and text, so that copies under ids of their own do not meet in one task."""
    doc_id, text = F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(doc_id, F.lit("")), text), 256))


def _row_components(docs: DataFrame, words: int, percent: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, source, n, component, component_id`` per row with shingles, and all rows with their ``n``."""
    if percent < 80:
        raise ValueError("combinations of four tokens need a similarity of 80 percent or more")
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    source = _source().alias("source")
    levels = token_levels(docs, words, frequent)
    summary = set_summaries(words, levels, percent)
    rows = docs.select(doc_id, source, summary(text.cast("binary")).alias("s"))
    rows = stage(rows.select("doc_id", "source", "s.*", F.monotonically_increasing_id().alias("id")), "shingles")
    some = rows.filter("n > 0")
    classes = stage(some.groupBy("digest").agg(F.min("id").alias("id"), F.min("doc_id").alias("least")), "classes")
    prefixes = some.filter("prefix is not null").select("id", "n", "prefix", "parity").hint("merge")
    prefixes = stage(prefixes.join(classes.select("id"), "id", "left_semi"), "prefixes")

    tokens = ranked_sets(words, levels)

    def texts_of(ids: DataFrame) -> DataFrame:
        asked = rows.select("id", "source").hint("merge").join(ids, "id", "left_semi")
        return docs.select(source, text.cast("binary").alias("text")).hint("merge").join(asked, "source")

    def sets_of(ids: DataFrame) -> DataFrame:
        return texts_of(ids).select("id", tokens(F.col("text")).alias("tokens"))

    def longer(ids: DataFrame, k: int) -> DataFrame:
        extended = set_summaries(words, levels, percent, k)
        return texts_of(ids).select("id", extended(F.col("text")).alias("s")).select("id", "s.n", "s.prefix", "s.parity").dropDuplicates(["id"])

    found = components(_linked(prefixes, sets_of, longer, percent, frequent))
    named = classes.hint("merge").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.hint("merge").join(least, "component").select("digest", "component", "component_id")
    joined = some.select("doc_id", "source", "n", "digest").hint("merge").join(named, "digest")
    return joined.select("doc_id", "source", "n", "component", "component_id"), rows


def one_per_component(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Of each component the row of the smallest ``doc_id``, nulls last; ties go by digests of text and columns.

    Rows are told apart by id and text, so two texts of one ``doc_id`` are judged each on their own. Rows
    without words link with nothing and are kept.
    """
    found, _ = _row_components(docs.select("doc_id", "text"), words, percent, FREQUENT)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "source"))
    kept = found.groupBy("component").agg(first.alias("first")).select(F.col("first.source").alias("_source"))
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = docs.filter(worded).withColumn("_source", _source()).hint("merge").join(kept, "_source", "left_semi")
    # Rows of one id and text are copies: the first by their other columns stays.
    rest = F.xxhash64(F.to_json(F.struct(F.lit(0), *[c for c in docs.columns if c not in ("doc_id", "text")])))
    one = named.groupBy("_source").agg(F.min_by(F.struct(*docs.columns), rest).alias("_row")).select("_row.*")
    return one.unionByName(docs.filter(~worded))
