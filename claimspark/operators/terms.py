"""Term statistics over token arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark import domain
from claimspark.functions.text import tokens
from claimspark.operators.keyed import previous

#: Texts that a tokenizer's task turns into Python strings at once.
SLICE_TEXTS = 64


def with_tokens(
    df: DataFrame, text: str, stopwords: Iterable[str], name: str = "tokens"
) -> DataFrame:
    return df.withColumn(name, tokens(F.col(text), stopwords))


def term_rows(df: DataFrame, *keep: Column | str, col: str = "tokens") -> DataFrame:
    """One row ``term`` per token.

    The outer form plus a filter on the result: for a plain explode Spark would add a non-empty
    filter on the array, push it down, and tokenise every text several times.
    """
    return df.select(*keep, F.explode_outer(col).alias("term")).filter("term is not null")


def term_frequency(df: DataFrame, col: str = "tokens") -> DataFrame:
    """``(term, n)`` over the whole corpus."""
    return term_rows(df, col=col).groupBy("term").agg(F.count("*").alias("n"))


def with_total(frequency: DataFrame) -> DataFrame:
    """Add the corpus size ``total`` to a frequency table."""
    return frequency.withColumn("total", frequency.agg(F.sum("n")).scalar())


def class_terms(df: DataFrame, by: str = "label", col: str = "tokens") -> DataFrame:
    """``(by, term, n)`` counts."""
    return term_rows(df, by, col=col).groupBy(by, "term").agg(F.count("*").alias("n"))


def top_terms(df: DataFrame, n: int = 10, by: str = "label", col: str = "tokens") -> DataFrame:
    """The ``n`` most frequent terms per class with their rank, ties in term order."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "term"))
    return class_terms(df, by, col).withColumn("rank", rank).filter(F.col("rank") <= n)


def distinctive_terms(
    df: DataFrame,
    n: int = 15,
    min_count: int = 3,
    labels: Sequence[str] = domain.LABELS,
    by: str = "label",
    col: str = "tokens",
) -> DataFrame:
    """Terms a class uses more than the corpus does: ``lift = (c_w / n_c) / (g_w / N)``.

    One aggregate by term holds the corpus count and one count per class; class and corpus
    totals are sums over it. Every token counts towards the totals, also rare ones.
    """
    terms = term_rows(df, F.col(by).alias("_by"), col=col)
    names = [f"c{i}" for i in range(len(labels))]
    counts = terms.groupBy("term").agg(
        F.count("*").alias("g"),
        *[F.count_if(F.col("_by") == c).alias(name) for c, name in zip(labels, names)],
    )
    totals = counts.agg(F.struct(F.sum("g").alias("g"), *[F.sum(c).alias(c) for c in names])).scalar()
    cells = F.array(
        *[
            F.struct(
                F.lit(label).alias(by),
                F.col(c).alias("n"),
                F.try_divide(F.try_divide(F.col(c), totals[c]), F.col("g") / totals["g"]).alias("lift"),
            )
            for label, c in zip(labels, names)
        ]
    )
    scored = counts.select("term", F.inline(cells)).filter(F.col("n") >= min_count)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("lift"), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n).select(by, "term", "n", "lift", "rank")


def frequent_vocabulary(df: DataFrame, n: int = 50, min_count: int = 2, col: str = "tokens") -> DataFrame:
    """The ``n`` most frequent terms that occur at least ``min_count`` times."""
    counts = term_frequency(df, col).filter(F.col("n") >= min_count)
    return counts.orderBy(F.desc("n"), "term").limit(n)


def with_frequency(vectors: DataFrame, frequency: DataFrame, term: str = "term") -> DataFrame:
    """Attach the corpus count to a table of terms."""
    return vectors.join(frequency.select(F.col("term").alias(term), "n"), term)


def piece_count(make_tokenizer: Callable[[], Callable[[str], Sequence]], special: int = 2):
    """A column function counting subwords with a caller-supplied tokenizer.

    ``make_tokenizer`` runs once per worker and returns a function from a text to its pieces;
    ``special`` pieces are added per text.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split = make_tokenizer()
        for texts in batches:
            # A few texts at a time: a batch of long ones is never held a second time as Python strings.
            parts = (texts.slice(i, SLICE_TEXTS).to_pylist() for i in range(0, len(texts), SLICE_TEXTS))
            yield pa.array((None if t is None else len(split(t)) + special for part in parts for t in part), pa.int64())

    return count


def per_step(df: DataFrame, step: str, value: str, run: str, name: str = "per_step") -> DataFrame:
    """Value minus the previous one of the run; the first stays as it is. ``(run, step)`` is unique.

    One sort and a scan with carried partition ends, so one long run is not sorted in one task
    and rows are not joined with each other.
    """
    rows = previous(df, run, step, [value])
    before = F.when(F.col("_previous").isNotNull(), F.col("_previous")[value]).otherwise(0)
    return rows.select(*df.columns, (F.col(value) - before).alias(name))
