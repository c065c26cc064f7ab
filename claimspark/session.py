"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType


#: Whether the shuffle files of a query are deleted as soon as it has ended, and not when the driver collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("claimspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    A session with a local master may run without the setting and gets a folder of its own;
    any other session without it raises, as a machine-local folder would lose rows there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="claimspark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Fix rows, partitions and order by a reliable checkpoint, so two passes see the same data."""
    shared = shared_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str, kinds: dict[str, DataType] | None = None, **options) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    ``kinds`` names columns that are read as another type of the same layout: a struct as the user
    type that stands on it. ``options`` go to the writer.

    For results that several later passes read: parsed or de-duplicated once, pruned by column
    after that, and not recomputed when an executor is lost.
    """
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, "false")
    conf.set(DROP_SHUFFLES, "true")  # what is written is read from its files: its shuffles go at once
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(DROP_SHUFFLES, before)
    fields = [StructField(f.name, (kinds or {}).get(f.name, f.dataType)) for f in df.schema]
    return df.sparkSession.read.schema(StructType(fields)).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read any more."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
