"""Harvest page drops as they arrive, into a claim table dealt into buckets by a hash of the URL.

A micro-batch reads and rewrites only the buckets that its pages fall into, as a new version in a
folder named by its batch id, and then lists them in a small manifest. A batch that is replayed
merges into the versions before it and overwrites itself. Readers take each bucket's newest
listed version, so the table is one row per URL without any work at reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from claimspark import domain
from claimspark.operators.extract import harvest_rows
from claimspark.operators.harvest import attach_claims, head, pending, upsert
from claimspark.operators.keyed import keep_last
from claimspark.session import scratch_path, stage
from claimspark.sources.tables import CLAIM_SCHEMA

PAGE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "html")])
#: Buckets of a claim table; choose more for a larger one, as a batch rewrites whole buckets.
BUCKETS = 64


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", bucket_of(F.col("url"), buckets))


def _versions(spark: SparkSession, table: str, before: int | None = None) -> list[tuple[int, int]]:
    """``(bucket, gen)``: the newest listed version of each bucket, older than ``before``."""
    try:
        listed = spark.read.schema("bucket int, gen long").parquet(f"{table}/_manifest")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    if before is not None:
        listed = listed.filter(F.col("gen") < before)
    newest = listed.groupBy("bucket").agg(F.max("gen").alias("gen"))
    return [(r.bucket, r.gen) for r in newest.collect()]  # at most one per bucket


def _read(spark: SparkSession, table: str, versions: Sequence[tuple[int, int]]) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], CLAIM_SCHEMA)
    paths = [f"{table}/gen={gen}/bucket={bucket}" for bucket, gen in versions]
    return spark.read.schema(CLAIM_SCHEMA).parquet(*paths)


def _write(rows: DataFrame, table: str, gen: int, buckets: Sequence[int]) -> None:
    """A version of some buckets, one file each, listed after it is whole."""
    files = rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket")
    files.parquet(f"{table}/gen={gen}")
    listed = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket int").coalesce(1)
    listed.write.mode("overwrite").parquet(f"{table}/_manifest/gen={gen}")


def run_harvest(
    spark: SparkSession,
    drops: str,
    targets: DataFrame,
    table: str,
    checkpoint: str,
    files_per_batch: int = 50,
    buckets: int = BUCKETS,
    limit: int | None = None,
    order: str | Sequence[str] = "seq",
) -> StreamingQuery:
    """Process every page file not seen yet, then stop; a restart resumes from the checkpoint.

    Only pages of known targets are kept. ``drops`` holds parquet files of ``(url, html)``.
    ``limit`` takes the first so many targets in ``order`` that the table does not hold yet. The
    targets are dealt into the same buckets once per run, so a batch reads only its own.
    """
    wanted = targets if limit is None else head(pending(targets, current_claims(spark, table)), limit, order)
    dealt = scratch_path(spark, "targets")
    _bucketed(wanted.select("url", "verdict"), buckets).repartition("bucket").write.partitionBy("bucket").parquet(dealt)
    files = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    arrival = ("_metadata.file_modification_time", "_metadata.file_name")
    pages = files.parquet(drops).select("url", "html", *arrival)

    def touched(rows: DataFrame) -> list[int]:
        return sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most `buckets`

    def flush(batch: DataFrame, batch_id: int) -> None:
        # A page without html leaves a row of nulls, so its target counts as tried.
        pages = batch.withColumn("filled", F.col("html").isNotNull())
        # Of a URL dropped twice in one batch the newest file counts; within a file, a page with html.
        arrived = ["file_modification_time", "file_name", "filled"]
        newest = keep_last(harvest_rows(pages, arrived), "url", arrived).drop(*arrived)
        newest = stage(_bucketed(newest, buckets), "harvested")
        known = spark.read.schema("url string, verdict string, bucket int").parquet(dealt)
        known = known.filter(F.col("bucket").isin(touched(newest))).drop("bucket")
        new = stage(_bucketed(attach_claims(known, newest.drop("bucket"), "inner"), buckets), "claims")
        own = touched(new)
        if not own:
            return
        old = _read(spark, table, [(b, g) for b, g in _versions(spark, table, batch_id) if b in set(own)])
        _write(_bucketed(upsert(old, new), buckets), table, batch_id, own)

    return (
        pages.writeStream.foreachBatch(flush)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_claims(spark: SparkSession, table: str) -> DataFrame:
    """The claim table: one row per URL."""
    return _read(spark, table, _versions(spark, table)).select(*domain.CLAIM_COLUMNS)


def compact(spark: SparkSession, table: str, out: str, buckets: int = BUCKETS) -> None:
    """Write the current claims to a new table, without the versions that they replaced."""
    rows = stage(_bucketed(current_claims(spark, table), buckets), "compacted")
    _write(rows, out, -1, [r.bucket for r in rows.select("bucket").distinct().collect()])  # at most `buckets`
