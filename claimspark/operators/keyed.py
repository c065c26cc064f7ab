"""Order-aware building blocks that never put a whole group or table into one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark import domain
from claimspark.session import pin, stage

#: Keys that hold at least ``1 / HOT_KEYS`` of all rows are hot, so there are at most that many.
HOT_KEYS = 10_000
#: Bits of a row number inside its partition; the partition's number stands above them.
ROW_BITS = 33


def _names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


# --- first and last rows --------------------------------------------------------------------


def _keep(df: DataFrame, key, order, pick) -> DataFrame:
    keys, order = _names(key), _names(order)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    kept = df.groupBy(*keys).agg(row)
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per key; nulls form one key.

    An aggregate rather than a window: copies of a hot key are reduced to one row per map task
    before the shuffle. For rows with long texts see ``keep_first_wide``.
    """
    return _keep(df, key, order, F.min_by)


def keep_last(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` per key."""
    return _keep(df, key, order, F.max_by)


def key_digest(key: str | Sequence[str]) -> Column:
    """SHA-256 of a key of any columns, null apart from every value: 32 bytes in place of a text."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in _names(key)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def keep_first_wide(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """``keep_first`` for wide rows and long keys; of rows with equal ``order`` one stays.

    The rows are staged with a row number and their key's digest. The winners' row numbers are
    found on those narrow columns, for a single order column in a hash aggregate with primitive
    buffers, and fetched by a semi-join on the number: copies of a hot key spread over all tasks
    and no long text is sorted.
    """
    columns, order = df.columns, _names(order)
    staged = df.select("*", key_digest(key).alias("_digest"), F.monotonically_increasing_id().alias("_row"))
    rows = stage(staged, "keyed")
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    # A null order comes first, as in a sort; within a struct it does so anyway.
    first = F.coalesce(F.min(F.when(by.isNull(), F.col("_row"))), F.min_by("_row", by))
    winners = rows.groupBy("_digest").agg(first.alias("_row")).select("_row")
    return rows.join(winners.hint("shuffle_hash"), "_row", "left_semi").select(*columns)


# --- scans over a total order ---------------------------------------------------------------


def ordered(df: DataFrame, order: str | Sequence[str]) -> DataFrame:
    """Rows range-partitioned and sorted, pinned, with ``_part`` and ``_at``, the place in it.

    Range bounds are sampled, so a second run could differ: the reliable checkpoint fixes them.
    """
    order = _names(order)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    pinned = pin(ranged.withColumn("_at", F.monotonically_increasing_id()))
    place = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return pinned.withColumn("_part", F.shiftright("_at", ROW_BITS)).withColumn("_at", place)


def partition_sums(rows: DataFrame, value: Column) -> DataFrame:
    """``(_part, _sum, _before)``: each partition's sum and that of all partitions before it.

    The first phase of a prefix scan: one row per partition, so the single-task window and a
    broadcast of the result are bounded by the number of partitions.
    """
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    return sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))


def dense_index(df: DataFrame, order: str | Sequence[str], name: str = "idx") -> DataFrame:
    """Number the rows 0, 1, 2, … in a total order without a single-task window."""
    rows = ordered(df, order)
    starts = F.broadcast(partition_sums(rows, F.lit(1)).select("_part", "_before"))
    numbered = rows.join(starts, "_part").withColumn(name, F.col("_before") + F.col("_at"))
    return numbered.select(*[c for c in df.columns if c != name], name)


def at_ranks(df: DataFrame, order: str | Sequence[str], ranks: Callable[[Column, Column, Column], Column], weight: str | None = None) -> DataFrame:
    """``(_rank, *df.columns)``: the rows at some ranks of a total order, counted from 0.

    ``ranks(total, first, after)`` is the array of wanted ranks from ``first`` up to before
    ``after`` among ``total`` rows; all of them together are broadcast and must be few. Rows are not
    numbered: the partition sums give each partition its ranks, and only there a row is looked
    up. With ``weight`` a row stands for so many equal ones; a running sum then runs inside the few
    partitions that hold a rank.
    """
    rows = ordered(df, order)
    sums = partition_sums(rows, F.col(weight) if weight else F.lit(1))
    total, before = F.sum("_sum").over(Window.partitionBy()), F.col("_before")
    wanted = sums.withColumn("_total", total).select(
        "_part", "_before", F.explode(ranks(F.col("_total"), before, before + F.col("_sum")).cast("array<bigint>")).alias("_rank")
    )
    found = wanted.select("_part", "_rank", (F.col("_rank") - before).alias("_place"))
    if weight is None:
        hits = F.broadcast(found.withColumnRenamed("_place", "_at"))
        return rows.join(hits, ["_part", "_at"]).select("_rank", *df.columns)
    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.join(F.broadcast(found.select("_part").distinct()), "_part", "left_semi")
    held = held.withColumn("_upto", F.sum(weight).over(upto))
    covers = (F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col(weight))
    return held.join(F.broadcast(found), "_part").filter(covers).select("_rank", *df.columns)


def stride_sample(df: DataFrame, k: int, order: str | Sequence[str]) -> DataFrame:
    """Rows 0, step, 2·step, … in order, at most ``k``, with ``step = max(1, n // max(k, 1))``.

    ``order`` must identify a row. Only those columns are sorted; the ``k`` picked rows are then
    looked up.
    """
    order = _names(order)

    def ranks(total: Column, first: Column, after: Column) -> Column:
        step = F.greatest(F.lit(1).cast("long"), F.floor(total / F.lit(max(k, 1))))
        low = F.ceil(first / step) * step
        high = F.least(after - 1, step * F.lit(k - 1))
        return F.when(low <= high, F.sequence(low, F.greatest(low, high), step)).otherwise(F.array().cast("array<bigint>"))

    picked = at_ranks(df.select(*order), order, ranks).select(*order)
    return df.join(F.broadcast(picked), order)  # at most k rows


def previous(df: DataFrame, run: str, step: str, cols: Sequence[str]) -> DataFrame:
    """Add ``_previous``: a struct of ``cols`` of the row before in its run by ``step``, else null.

    The second phase of a prefix scan: rows are sorted once by run and step, each partition learns
    the last row of the one before it, and a local pass over Arrow batches shifts by one row. A
    run of any length spreads over many tasks and no row meets another by a join.
    """
    rows = ordered(df, [run, step])
    last = rows.groupBy("_part").agg(F.max_by(F.struct(F.col(run).alias("_run"), *cols), "_at").alias("_last"))
    carry = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_carry"))
    rows = rows.join(F.broadcast(carry), "_part").select(*df.columns, "_carry")  # one row per partition
    names, kinds = df.columns, T.StructType([df.schema[c] for c in cols])
    schema = T.StructType([*df.schema.fields, T.StructField("_previous", kinds)])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # run and columns of the last row seen; none before the first row of all
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c) for c in (run, *cols)]
            known = True
            if held is None:
                carried = batch.column("_carry").slice(0, 1)
                held, known = carried.flatten(), carried[0].is_valid
            before = [pa.concat_arrays([h.cast(o.type), o.slice(0, len(o) - 1)]) for h, o in zip(held, own)]
            same = pa.compute.equal(before[0], own[0]).fill_null(False)
            neither = pa.compute.and_(before[0].is_null(), own[0].is_null())
            mask = ~pa.compute.or_(same, neither).to_numpy(zero_copy_only=False)
            mask[:1] |= not known
            found = pa.StructArray.from_arrays(before[1:], names=list(cols), mask=pa.array(mask))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], found], names=[*names, "_previous"])
            held = [o.slice(len(o) - 1) for o in own]

    return rows.mapInArrow(shift, schema)


# --- exact cuts -----------------------------------------------------------------------------


def hash_rank_key(key: Column, seed: int) -> Column:
    """Reproducible shuffle key: the order of ``md5(seed|key)``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def _stratum(c: str) -> Column:
    """A key of any label: null has one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def stratified_cut(
    df: DataFrame,
    strata: str,
    key: str,
    parts: Sequence[tuple[str, float]],
    seed: int = domain.SEED,
    name: str = "split",
    digits: int = 4,
    hashed: str | None = None,
    sizes: Mapping[str, Sequence[int]] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Assign each row to a part with exact, half-even rounded counts per stratum.

    Every part but the last gets ``round(n · share)`` rows of the stratum, the last the rest.
    Membership follows ``md5(seed|key)``. Rows of one key are told apart by a row number, for
    which the rows are staged; ``unique`` says that no stratum repeats a key and saves that.

    Instead of ranking whole strata (one class may hold most rows), a histogram of hash prefixes
    finds the bucket of every cut point; only those buckets are ranked to get the hash at the
    cut, and each row compares its hash with the few cut hashes of its stratum.
    Strata come from the data; null is one of its own and every row is kept. The cut hashes of
    strata with many rows are broadcast, those of the others joined.
    ``hashed`` names a column that already holds the hash, and is not part of the result.
    ``sizes`` gives each stratum's row counts of all parts but the last, in place of shares.
    """
    order = F.col(hashed) if hashed else hash_rank_key(F.col(key), seed)
    rows = df.withColumn("_hash", order).withColumn("_stratum", _stratum(strata))
    if not unique:
        rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "cut")
        rows = rows.withColumn("_hash", F.concat("_hash", F.lpad(F.hex("_row"), 16, "0"))).drop("_row")
    prefix = F.substring("_hash", 1, digits)
    buckets = rows.groupBy("_stratum", prefix.alias("_prefix")).agg(F.count("*").alias("_rows"), F.any_value(strata).alias("_label"))
    buckets = stage(buckets, "buckets")
    # Few strata, the usual case: their cuts are broadcast. Beyond that only the frequent ones are.
    few = buckets.select("_stratum").distinct().count() * len(parts) <= HOT_KEYS
    met = (lambda big, small, key: big.join(F.broadcast(small), key)) if few else (lambda big, small, key: join_hot(big, small, key, "_rows"))
    whole = Window.partitionBy("_stratum")
    upto = whole.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts, cut = [], F.lit(0).cast("double")
    for i, (_, share) in enumerate(parts[:-1]):
        if sizes is None:
            size = F.bround(F.col("_total") * F.lit(share), 0)
        else:
            size = F.coalesce(*[F.when(F.col("_label").eqNullSafe(F.lit(v)), F.lit(float(n[i]))) for v, n in sizes.items()])
        cut = cut + size
        cuts.append(cut)
    bounds = (
        buckets.withColumn("_high", F.sum("_rows").over(upto))
        .withColumn("_total", F.sum("_rows").over(whole))
        .select(
            "_stratum",
            "_prefix",
            "_rows",
            (F.col("_high") - F.col("_rows")).alias("_low"),
            "_high",
            F.posexplode(F.array(*cuts)).alias("_cut", "_at"),
        )
        .filter("_low < _at and _at <= _high")
        .select("_stratum", "_prefix", "_rows", F.struct("_cut", (F.col("_at") - F.col("_low")).cast("long").alias("_nth")).alias("_want"))
        .groupBy("_stratum", "_prefix")
        .agg(F.max("_rows").alias("_rows"), F.collect_list("_want").alias("_want"))  # at most one per part
        .withColumn("_bucket", F.concat("_stratum", F.lit("\u0000"), "_prefix"))
    )
    # Buckets that hold a cut: at most one per stratum and part.
    narrow = rows.select("_stratum", "_hash", F.concat("_stratum", F.lit("\u0000"), prefix).alias("_bucket"))
    ranked = (
        met(narrow, bounds.select("_bucket", "_rows", "_want"), "_bucket")
        .withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash")))
        .select("_stratum", "_hash", "_rank", F.inline("_want"))
        .filter("_rank = _nth")
    )
    counts = buckets.groupBy("_stratum").agg(F.sum("_rows").alias("_rows"))
    found = ranked.groupBy("_stratum").agg(
        *[F.max(F.when(F.col("_cut") == i, F.col("_hash"))).alias(f"_mark{i}") for i in range(len(cuts))]
    )
    marks = counts.join(found, "_stratum", "left")
    part = F.lit(parts[-1][0])
    for i in reversed(range(len(cuts))):
        below = F.col("_hash") <= F.coalesce(F.col(f"_mark{i}"), F.lit(""))
        part = F.when(below, F.lit(parts[i][0])).otherwise(part)
    marked = met(rows, marks, "_stratum").withColumn(name, part)
    return marked.select(*[c for c in df.columns if c not in (name, hashed)], name)


def join_hot(big: DataFrame, small: DataFrame, key: str, rows: str, hot: int = HOT_KEYS) -> DataFrame:
    """Inner join of many rows per key with one row per key, the frequent keys by broadcast.

    ``rows`` is the column of ``small`` with the number of ``big`` rows of the key. Keys with at
    least ``1 / hot`` of all of them are at most ``hot``, which bounds the broadcast; their rows
    of ``big`` do not move. The others are joined by a shuffle, where no key is large. ``big`` is
    read twice: hand in a staged table.
    """
    limit = small.agg(F.coalesce(F.sum(rows), F.lit(0)) / F.lit(hot)).scalar()
    often = F.broadcast(small.filter(F.col(rows) >= limit))
    seldom = small.filter(F.col(rows) < limit)
    columns = [*big.columns, *[c for c in small.columns if c != key]]
    rest = big.join(often.select(key), key, "left_anti").join(seldom, key)
    return big.join(often, key).select(*columns).unionByName(rest.select(*columns))
