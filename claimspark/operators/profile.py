"""Exploratory profiles: missingness, selection, time, disagreement, lengths, label leaks."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark import domain
from claimspark.functions.dates import LOCAL, wall_clock
from claimspark.functions.text import contains_word, is_single_word, word_count
from claimspark.operators.dataset import class_table
from claimspark.operators.keyed import at_ranks
from claimspark.session import stage

# The percentiles of a length description.
PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _null(c: str) -> Column:
    return F.col(c).isNull()


def missing_table(df: DataFrame) -> DataFrame:
    """``(column, n_missing, percent)`` of the columns with nulls, from one aggregate."""
    row = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(_null(c)).alias(f"n:{c}") for c in df.columns]
    )
    counts = row.unpivot(["_rows"], [f"n:{c}" for c in df.columns], "column", "n_missing")
    percent = F.bround(F.col("n_missing") * 100.0 / F.col("_rows"), 2)
    return counts.filter("n_missing > 0").select(
        F.substr("column", F.lit(3)).alias("column"), "n_missing", percent.alias("percent")
    )


def nullity_patterns(df: DataFrame) -> DataFrame:
    """Rows per combination of missing columns."""
    return df.groupBy(*[_null(c).alias(c) for c in df.columns]).agg(F.count("*").alias("n"))


def nullity_correlation(df: DataFrame) -> DataFrame:
    """``(left_column, right_column, correlation)`` of null flags, columns that vary only."""
    pairs = list(itertools.combinations(df.columns, 2))
    flags = df.select(*[_null(c).cast("double").alias(c) for c in df.columns])
    # Pattern counts first, so the pairwise sums run over few rows whatever the table's size.
    patterns = flags.groupBy(*flags.columns).agg(F.count("*").cast("double").alias("_n"))
    n = F.sum("_n")
    ones = {c: F.sum(F.col(c) * F.col("_n")) for c in df.columns}

    def corr(a: str, b: str) -> Column:
        both = F.sum(F.col(a) * F.col(b) * F.col("_n"))
        spread = (n * ones[a] - ones[a] * ones[a]) * (n * ones[b] - ones[b] * ones[b])
        return F.try_divide(n * both - ones[a] * ones[b], F.sqrt(spread))

    row = patterns.agg(*[corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"p{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*cells))).filter("correlation is not null")


def _digest(cols: Sequence[str]) -> Column:
    packed = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(packed, 256))


def duplicate_counts(df: DataFrame, text: str) -> DataFrame:
    """Repeats beyond the first, of whole rows and of one text column (null is one value).

    Rows are compared by a SHA-256 digest, so whole texts never reach the shuffle, and copies of
    one row are counted before it.
    """

    def repeats(cols: Sequence[str], name: str) -> DataFrame:
        groups = df.groupBy(_digest(cols)).agg(F.count("*").alias("_n"))
        return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")).select(
            F.lit(name).alias("kind"), "n"
        )

    return repeats(df.columns, "row").unionByName(repeats([text], "text"))


def shape_table(df: DataFrame) -> DataFrame:
    """``(column, dtype, n_rows, n_filled)`` per column."""
    row = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("dtype"),
            F.col("_rows").alias("n_rows"),
            F.col(c).alias("n_filled"),
        )
        for c, t in df.dtypes
    ]
    return row.select(F.inline(F.array(*cells)))


def retention(df: DataFrame, by: str = "verdict", text: str = "corpus") -> DataFrame:
    """Rows before and after requiring a text, per class, from one pass; the null class is out."""
    counts = (
        df.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(F.count("*").alias("n_before"), F.count(text).alias("n_after"))
    )
    pct = F.bround(F.col("n_after") * 100.0 / F.col("n_before"), 1)
    return counts.withColumn("retention_pct", pct)


def share_shift(df: DataFrame, by: str = "verdict", text: str = "corpus") -> DataFrame:
    """Share of each class before and after the selection, and the difference."""
    counts = retention(df, by, text)
    totals = counts.agg(F.struct(F.sum("n_before").alias("b"), F.sum("n_after").alias("a"))).scalar()
    before = F.try_divide(F.col("n_before") * 1.0, totals["b"])
    after = F.try_divide(F.col("n_after") * 1.0, totals["a"])
    return counts.select(
        by, before.alias("share_before"), after.alias("share_after"), (after - before).alias("shift")
    )


def counts_per_year(df: DataFrame, date: str = "date", zone: str = LOCAL) -> DataFrame:
    year = F.year(wall_clock(F.col(date), zone)).alias("year")
    return df.groupBy(year).agg(F.count("*").alias("n")).filter("year is not null")


def counts_per_month(df: DataFrame, date: str = "date", zone: str = LOCAL) -> DataFrame:
    """Calendar months pooled over the years."""
    month = F.month(wall_clock(F.col(date), zone)).alias("month")
    return df.groupBy(month).agg(F.count("*").alias("n")).filter("month is not null")


def label_drift(
    df: DataFrame, labels: Sequence[str] = domain.LABELS, date: str = "date", zone: str = LOCAL
) -> DataFrame:
    """Class counts per year, one column per class."""
    year = F.year(wall_clock(F.col(date), zone)).alias("year")
    return df.filter(wall_clock(F.col(date), zone).isNotNull()).groupBy(year).agg(
        *[F.count_if(F.col("label") == c).alias(c) for c in labels]
    )


def distributions(df: DataFrame, cols: Sequence[str] = ("verdict", "rating")) -> DataFrame:
    """``(column, value, n)`` for several columns, nulls left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
    return (
        df.select(F.inline(cells)).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    )


def _differ(a: str, b: str) -> Column:
    """Unequal, where a null on either or both sides counts as different."""
    return ~F.coalesce(F.col(a) == F.col(b), F.lit(False))


def disagreements(df: DataFrame, a: str = "verdict", b: str = "rating") -> DataFrame:
    return df.filter(_differ(a, b))


def disagreement_count(df: DataFrame, a: str = "verdict", b: str = "rating") -> DataFrame:
    return df.agg(F.count_if(_differ(a, b)).alias("n"))


def with_length(df: DataFrame, text: str, name: str = "n_words") -> DataFrame:
    return df.withColumn(name, word_count(F.col(text)))


def percentiles(df: DataFrame, col: str, shares: Sequence[float] = PERCENTILES) -> DataFrame:
    """``(share, value)``: exact, linearly interpolated percentiles of a number, nulls and NaN left out.

    Equal values are counted first. The distinct values are range-partitioned, the partitions'
    counts summed up, and only those partitions are searched that hold a wanted rank, so any
    number of distinct values spreads over the tasks.
    """
    values = df.select(F.col(col).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    counts = values.groupBy("x").agg(F.count("*").alias("n"))
    places = lambda total: [F.lit(p) * (total - 1) for p in shares]

    def ranks(total: Column, first: Column, after: Column) -> Column:
        wanted = F.array_distinct(F.array(*[f(at).cast("long") for at in places(total) for f in (F.floor, F.ceil)]))
        return F.filter(wanted, lambda r: (r >= first) & (r < after))

    # At most two rows per share from here on.
    found = at_ranks(counts, "x", ranks, "n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "x"))).alias("_at"))
    total = values.agg(F.count("*")).scalar()
    cells = []
    for share, at in zip(shares, places(total)):
        low, high = (F.try_element_at("_at", f(at).cast("long")) for f in (F.floor, F.ceil))
        # As `percentile` interpolates: weights by the distance to either rank.
        between = F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
        cells.append(F.struct(F.lit(share).alias("share"), between.alias("value")))
    return found.select(F.inline(F.array(*cells)))


def describe(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Count, mean, sample deviation, extremes and linearly interpolated percentiles.

    Exact for any number of distinct values; the column is staged, as several passes read it.
    ``approx`` settles for a sketch in one pass.
    """
    c = F.col(col)
    if not approx:
        df = stage(df.select(col), "described")
    row = df.agg(
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        *[F.percentile_approx(c, list(PERCENTILES), 10000).alias("_q")] * approx,
    )
    if not approx:
        pairs = F.array_sort(F.collect_list(F.struct("share", "value")))
        row = row.withColumn("_q", percentiles(df, col).agg(F.transform(pairs, lambda q: q["value"])).scalar())
    named = [F.col("_q")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(PERCENTILES)]
    return row.select("count", "mean", "std", "min", *named, "max")


def single_token_texts(df: DataFrame, text: str) -> DataFrame:
    return df.filter(is_single_word(F.col(text)))


def length_histogram(df: DataFrame, by: str = "label", length: str = "n_words") -> DataFrame:
    """Rows per class and length (bin width 1)."""
    return df.groupBy(by, length).agg(F.count("*").alias("n"))


def length_density(
    df: DataFrame, by: str = "label", length: str = "n_words", points: int = 200, cut: float = 3.0
) -> DataFrame:
    """Gaussian density of the length per class on an even grid, weighted by class share.

    Scott's bandwidth; the grid reaches ``cut`` bandwidths beyond the extremes. Works on the
    length histogram, so its cost follows the number of distinct lengths, not of rows.
    """
    hist = length_histogram(df, by, length).filter(F.col(by).isNotNull() & F.col(length).isNotNull())
    x, n = F.col(length).cast("double"), F.col("n").cast("double")
    total = F.sum(n)
    variance = (F.sum(n * x * x) - F.sum(n * x) * F.sum(n * x) / total) / (total - 1)
    stats = (
        hist.groupBy(by)
        .agg(total.alias("_n"), F.min(x).alias("_min"), F.max(x).alias("_max"), variance.alias("_var"))
        .filter("_n > 1 and _var > 0")
        .withColumn("_bw", F.sqrt("_var") * F.pow("_n", F.lit(-0.2)))
    )
    all_rows = hist.agg(total).scalar()
    low, high = F.col("_min") - cut * F.col("_bw"), F.col("_max") + cut * F.col("_bw")
    steps = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    grid = stats.select(by, "_bw", low.alias("_low"), high.alias("_high"), steps)
    x_at = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("point") / F.lit(points - 1)
    grid = grid.select(by, "_bw", "point", x_at.alias("x"))
    z = (F.col("x") - F.col(length)) / F.col("_bw")
    kernel = F.col("n") * F.exp(-0.5 * z * z)
    scale = F.col("_bw") * F.sqrt(F.lit(2.0) * F.pi()) * all_rows
    return (
        hist.join(grid, by)
        .groupBy(by, "point", "x", "_bw")
        .agg(F.sum(kernel).alias("_sum"))
        .select(by, "point", "x", (F.col("_sum") / scale).alias("density"))
    )


def short_text_crosstab(
    df: DataFrame,
    labels: Sequence[str] = domain.LABELS,
    by: str = "label",
    length: str = "n_words",
    longest: int = 5,
) -> DataFrame:
    """Rows per length up to ``longest``, one column per class."""
    short = df.filter(F.col(length) <= longest)
    return short.groupBy(length).agg(*[F.count_if(F.col(by) == c).alias(c) for c in labels])


def label_leaks(df: DataFrame, text: str, labels: Sequence[str] = domain.LABELS) -> DataFrame:
    """``(word, n, warn)``: rows whose text contains the label as a whole word."""
    low = F.lower(F.col(text))
    names = [c.lower() for c in labels]
    row = df.agg(*[F.count_if(contains_word(low, w)).alias(w) for w in names])
    return row.unpivot([], names, "word", "n").withColumn("warn", F.col("n") > 0)


def class_distribution(
    df: DataFrame, labels: Sequence[str] = domain.LABELS, by: str = "label"
) -> DataFrame:
    """``(position, label, n)`` in a fixed class order; an absent class has a null count."""
    order = class_table(df.sparkSession, labels).toDF("position", "label")
    counts = df.groupBy(F.col(by).alias("label")).agg(F.count("*").alias("n"))
    return order.join(counts, "label", "left").select("position", "label", "n")
