"""Session defaults, and the shared folder where written tables cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def builder(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession.Builder:
    """A builder with the settings the library is tested under."""
    return (
        SparkSession.builder.master(master)
        .appName("marginalia")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, whatever folder the driver runs in, and keeps the batches
    that they get small: texts may be long. Shuffle files go as soon as the query that wrote them ends:
    what is needed later is stashed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, as in tests, one of our own: only on a
    local master, as executors elsewhere would not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


#: Rows in a batch for Python workers, and bytes beyond which it ends earlier.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20
#: Paths of stashed tables, by the innermost recording() that was open.
_RECORDS: list[list[str]] = []


@contextmanager
def recording() -> Iterator[list[str]]:
    """Collects the paths of tables that are stashed meanwhile, for a later drop_paths()."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.remove(paths)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stash(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder, partitioned by a column if named, and reads it back:
    lineage ends here, and a lost executor costs only a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    if _RECORDS:
        _RECORDS[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(*tables: DataFrame) -> None:
    """Deletes tables made by stash(); call only when nothing lazy reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/tables/" in path.toString():
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
