"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

A paragraph is a line, or each ``PARAGRAPH`` characters of a longer one. A cell holds the count of
its digests, their XOR and the XOR of their checks. The sketches of two versions subtract cell by
cell, which leaves the digests of one version only; peeling cells of one digest recovers those.
Digests are dealt into groups of about ``GROUP``, whose sketches are peeled on their own; a
group that does not peel is sketched again with twice the cells. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.session import stage

PARAGRAPH = 160
GROUP = 8
CELLS = 15
#: Sizes that are tried, doubling; a group that none peels is compared digest by digest.
TRIES = 5
ROUNDS = 8
#: Ids that share a bucket, as a power of two.
BUCKET_BITS = 8


def paragraphs(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    found = F.regexp_extract_all(text, F.lit(r"[^\n]{1,%d}" % PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def _cell(count: Column, key: Column, check: Column) -> Column:
    return F.struct(count.alias("n"), key.alias("k"), check.alias("c"))


def _check(key: Column) -> Column:
    return F.xxhash64(F.lit(7), key)


def _places(key: Column, cells: int) -> Column:
    third = cells // 3
    return F.array(*[(F.pmod(F.xxhash64(F.lit(31 * cells + j), key), F.lit(third)) + j * third).cast("int") for j in range(3)])


def _take(cells: Column, entries: Column) -> Column:
    """Cells less the signed digests in ``entries`` (``n, k, c, at``)."""
    less = lambda x, e: _cell(x["n"] - e["n"], x["k"].bitwiseXOR(e["k"]), x["c"].bitwiseXOR(e["c"]))
    return F.transform(cells, lambda x, i: F.aggregate(F.filter(entries, lambda e: F.array_contains(e["at"], i)), x, less))


def _entry(key: Column, sign: Column, cells: int) -> Column:
    return F.struct(sign.cast("int").alias("n"), key.alias("k"), _check(key).alias("c"), _places(key, cells).alias("at"))


def sketch(keys: Column, cells: int = CELLS, sign: int = 1) -> Column:
    """The cells of a set of digests."""
    zero = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    entries = F.transform(keys, lambda k: _entry(k, F.lit(-sign), cells))
    return F.transform(F.array(entries), lambda e: _take(F.array_repeat(zero, cells), e))[0]


def subtract(left: Column, right: Column) -> Column:
    less = lambda a, b: _cell(a["n"] - b["n"], a["k"].bitwiseXOR(b["k"]), a["c"].bitwiseXOR(b["c"]))
    return F.zip_with(left, right, less)


def peel(cells: Column, size: int) -> Column:
    """Struct ``left, right`` of digests that only one side holds; null if the cells do not peel."""
    none = F.array().cast("array<bigint>")

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["c"] == _check(x["k"])))
        found = F.array_distinct(F.transform(pure, lambda x: _entry(x["k"], x["n"], size)))

        def keep(entries: Column) -> Column:
            side = lambda sign: F.transform(F.filter(entries, lambda e: e["n"] == sign), lambda e: e["k"])
            return F.struct(
                _take(state["cells"], entries).alias("cells"),
                F.concat(state["left"], side(1)).alias("left"),
                F.concat(state["right"], side(-1)).alias("right"),
            )

        changed = F.transform(F.array(found), keep)[0]  # binds the entries once
        return F.when(F.forall(state["cells"], lambda x: x["n"] == 0), state).otherwise(changed)

    start = F.struct(cells.alias("cells"), none.alias("left"), none.alias("right"))
    empty = lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)
    done = lambda s: F.when(F.forall(s["cells"], empty), F.struct(s["left"], s["right"]))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, done)


def _serial(keys: Column) -> Column:
    parts = F.transform(sketch(keys), lambda x: F.concat_ws(".", F.hex(x["n"].cast("long")), F.hex(x["k"]), F.hex(x["c"])))
    return F.concat_ws("-", parts)


def differences(pairs: DataFrame) -> DataFrame:
    """``row, pair, left_only, right_only, left_size, right_size`` for digest arrays ``a`` and ``b``."""
    groups = F.greatest(F.lit(1), F.ceil((F.size("a") + F.size("b")) / GROUP))
    side = lambda name, s: F.transform(name, lambda k: F.struct(k.alias("k"), F.lit(s).alias("s")))
    keys = pairs.select("row", "pair", groups.alias("g"), F.explode(F.concat(side("a", 0), side("b", 1))).alias("e"))
    keys = keys.select("row", "pair", F.pmod(F.xxhash64(F.lit(3), "e.k"), "g").alias("group"), "e.k", "e.s")
    held = keys.groupBy("row", "pair", "group").agg(*[F.collect_list(F.when(F.col("s") == s, F.col("k"))).alias(n) for s, n in ((0, "a"), (1, "b"))])
    tries = [peel(subtract(sketch(F.col("a"), CELLS << t), sketch(F.col("b"), CELLS << t)), CELLS << t) for t in range(TRIES)]
    plain = F.struct(F.array_except("a", "b").alias("left"), F.array_except("b", "a").alias("right"))
    found = held.select("row", "pair", F.size("a").alias("x"), F.size("b").alias("y"), F.coalesce(*tries, plain).alias("d"))
    sums = {"left_only": F.size("d.left"), "right_only": F.size("d.right"), "left_size": F.col("x"), "right_size": F.col("y")}
    return found.groupBy("row", "pair").agg(*[F.sum(v).alias(n) for n, v in sums.items()])


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, bucket, next_text``: the text of the next row by descending ``doc_id``.

    The last row is followed by the first. Rows of one id follow each other by text. Ids are
    dealt into buckets of neighbours; only the highest row of each bucket is looked up across them.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.filter("doc_id is not null").withColumn("bucket", F.shiftright("doc_id", BUCKET_BITS))
    within = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(within))
    heads = docs.filter("doc_id is not null").groupBy(F.shiftright(F.col("doc_id").cast("long"), BUCKET_BITS).alias("bucket"))
    heads = heads.agg(F.min_by(F.coalesce("text", F.lit("")), F.struct(-F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))).alias("head"))
    heads = stage(heads, "heads")
    outer = Window.partitionBy(F.shiftright("bucket", 12).alias("outer")).orderBy(F.desc("bucket"))
    chain = heads.select("bucket", F.lead("bucket").over(outer).alias("below"))
    tops = heads.groupBy(F.shiftright("bucket", 12).alias("outer")).agg(F.max("bucket").alias("top"), F.min("bucket").alias("low"))
    order = Window.orderBy(F.desc("outer"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    jumps = tops.select("low", F.coalesce(F.lead("top").over(order), F.first("top").over(whole)).alias("jump"))
    chain = chain.join(jumps, chain["bucket"] == jumps["low"], "left").select("bucket", F.coalesce("below", "jump").alias("below"))
    chain = chain.join(heads.select(F.col("bucket").alias("below"), "head"), "below").select("bucket", "head")
    joined = rows.hint("merge").join(chain, "bucket")
    return joined.select("doc_id", "text", F.coalesce("next_text", "head").alias("next_text"))


def text_sketches(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has its last half replaced by the start of the next text. Likeness is
    the Jaccard similarity of paragraph digests, from the recovered differences; two texts
    without paragraphs are alike. A null text is empty. A row with a null ``doc_id`` has no place in the
    order: its edited text is its text and ``near_next`` is null. Other columns are ignored; an empty
    table gives no rows; the only row is its own next.
    """
    bare = docs.filter("doc_id is null").select(
        F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("next_text")
    )
    rows = with_next(docs).unionByName(bare).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edit = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", F.coalesce(edit, "text"))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("a"),
        paragraphs(F.col("edited")).alias("e"), paragraphs(F.col("next_text")).alias("x"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "digests")
    pairs = F.array(*[F.struct(F.lit(n).alias("pair"), F.col(c).alias("b")) for n, c in ((0, "e"), (1, "x"))])
    pairs = rows.select("row", "a", F.explode(pairs).alias("p")).select("row", "a", "p.pair", "p.b").filter("b is not null")
    like = (F.col("left_size") - F.col("left_only")) / (F.col("left_size") + F.col("right_only"))
    found = differences(pairs).groupBy("row").agg(*[F.max(F.when(F.col("pair") == n, like)).alias(c) for n, c in ((0, "near_e"), (1, "near_x"))])
    joined = rows.join(found, "row", "left")
    none = lambda c: F.when(F.size("a") + F.size(c) == 0, 1.0)
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", _serial(F.col("a")).alias("fingerprint"), _serial(F.col("e")).alias("edited_fingerprint"),
        F.coalesce("near_e", none("e")).alias("near_edited"), F.coalesce("near_x", F.when(F.col("x").isNotNull(), none("x"))).alias("near_next"),
    )
