"""The modelling dataset: select, clean, relabel, de-duplicate, split once and freeze."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark import domain
from claimspark.functions.dates import LOCAL, wall_clock
from claimspark.functions.labels import binary_label, rewrite
from claimspark.functions.text import is_multiword
from claimspark.operators.keyed import hash_rank_key, keep_first_wide, stratified_cut
from claimspark.session import stage
from claimspark.sources.tables import write_table

# The columns of the exploratory view.
EDA_DROP = ("jsonld_types",)
EDA_RENAME = {"claim_reviewed": "corpus", "pub_date": "date", "has_claimreview": "has_review"}


def eda_view(
    claims: DataFrame, drop: Sequence[str] = EDA_DROP, rename: Mapping[str, str] = EDA_RENAME
) -> DataFrame:
    """Drop and rename columns and normalise the rating, before any selection."""
    view = claims.drop(*drop).withColumnsRenamed(dict(rename))
    return view.withColumn("rating", rewrite(F.col("rating"), domain.RATING_NORMALIZE))


def with_label(claims: DataFrame, source: str = "rating", name: str = "label") -> DataFrame:
    """Normalise the rating, then merge it into the modelling classes."""
    label = rewrite(F.col(source), domain.RATING_NORMALIZE, domain.RATING_MERGE)
    return claims.withColumn(name, label)


def with_claim(claims: DataFrame, text: str = "claim_reviewed") -> DataFrame:
    return claims.na.drop(subset=[text])


def multiword(claims: DataFrame, text: str = "claim_reviewed") -> DataFrame:
    """Drop texts of a single token (URLs) and of none."""
    return claims.filter(is_multiword(F.col(text)))


def with_known_label(
    claims: DataFrame, labels: Sequence[str] = domain.LABELS, name: str = "label"
) -> DataFrame:
    return claims.filter(F.col(name).isin(*labels))


def build_dataset(
    claims: DataFrame,
    labels: Sequence[str] = domain.LABELS,
    positive: str = domain.BINARY_POSITIVE,
    order: str = "seq",
) -> DataFrame:
    """``(text, label, label_binary, date, url, order)``, one row per usable claim.

    The filters come before the de-duplication, so the first *usable* copy of a text stays.
    """
    usable = with_known_label(multiword(with_claim(with_label(claims))), labels)
    narrow = usable.select("claim_reviewed", "label", "pub_date", "url", order)
    kept = keep_first_wide(narrow, "claim_reviewed", order)
    return kept.select(
        F.col("claim_reviewed").alias("text"),
        "label",
        binary_label(F.col("label"), positive).alias("label_binary"),
        F.col("pub_date").alias("date"),
        "url",
        order,
    )


def add_splits(
    dataset: DataFrame,
    seed: int = domain.SEED,
    parts: Sequence[tuple[str, float]] = domain.SPLITS,
    key: str = "text",
) -> DataFrame:
    """Exact stratified hold-out per label, reproducible for a seed; labels come from the data."""
    return stratified_cut(dataset, "label", key, parts, seed)


def split_summary(dataset: DataFrame) -> DataFrame:
    """``(split, label, n, totals)``: rows per split and label, and over either or both.

    ``totals`` tells a total from a row whose label or split is null: 0 for a group of its own, 1
    for a total over the labels, 2 over the splits, 3 over both.
    """
    counts = dataset.cube("split", "label").agg(F.count("*").alias("n"), F.grouping_id().alias("totals"))
    return counts.withColumn("totals", F.col("totals").cast("int"))


def build_processed(
    claims: DataFrame,
    path: str | None = None,
    seed: int = domain.SEED,
    fmt: str = "parquet",
    **options,
) -> DataFrame:
    """Dataset with its frozen split; written partitioned by split when a path is given.

    The de-duplicated rows are staged with their shuffle hash: finding the cut points then reads
    two narrow columns, and the pass that assigns the splits needs no shuffle.
    """
    rows = build_dataset(claims, **options)
    if path:
        rows = stage(rows.withColumn("_order", hash_rank_key(F.col("text"), seed)), "dataset")
        dataset = stratified_cut(rows, "label", "text", domain.SPLITS, seed, hashed="_order", unique=True)
        write_table(dataset, path, domain.DATASET_COLUMNS, fmt, ["split"] if fmt == "parquet" else [])
        return dataset
    return add_splits(rows, seed)


def class_table(spark, classes: Sequence[str] = domain.CLASSES) -> DataFrame:
    """``(label_id, label)`` in the given class order."""
    names = F.array(*[F.lit(c) for c in classes])
    return spark.range(1).select(F.posexplode(names).alias("label_id", "label"))


def with_label_ids(dataset: DataFrame, classes: Sequence[str] = domain.CLASSES) -> DataFrame:
    """Attach the class id; labels outside ``classes`` raise a ``ValueError`` that names all of them."""
    known = F.coalesce(F.col("label").isin(*classes), F.lit(False))
    strays = dataset.filter(~known).select("label").distinct().collect()  # normally none
    if strays:
        raise ValueError(f"unexpected labels in dataset: {sorted(str(r.label) for r in strays)}")
    ids = F.broadcast(class_table(dataset.sparkSession, classes))  # one row per class
    return dataset.join(ids, "label").select(*dataset.columns, "label_id")


def split_rows(dataset: DataFrame, split: str, columns: Sequence[str] = ()) -> DataFrame:
    rows = dataset.filter(F.col("split") == split)
    return rows.select(*columns) if columns else rows


def chronological(
    claims: DataFrame, date: str = "date", zone: str = LOCAL, order: str = "seq"
) -> DataFrame:
    """Parse the dates (unparsable ones become null and come last) and sort ascending."""
    dated = claims.withColumn(date, wall_clock(F.col(date), zone))
    return dated.orderBy(F.col(date).asc_nulls_last(), order)
