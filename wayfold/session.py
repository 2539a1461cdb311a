"""Session settings and the two helpers that touch storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: int | str = 8, app: str = "wayfold", **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "12g")
               .config("spark.sql.shuffle.partitions", str(cores if cores != "*" else 8)))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster that
    folder would vanish with the machine that holds it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="wayfold-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage for iterative jobs; the table outlives any lost executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes up to which ``spread`` deals an input anew.
SMALL = 1 << 30

#: Rows that a part has about where a step sorts or folds its rows in memory.
PART_ROWS = 1 << 18


def parts_for(spark: SparkSession, rows: int) -> int:
    """Parts that so many rows are dealt to, so that what a task holds does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Keep the rows of ``df`` on the executors' disks once something has computed them."""
    _kept.append(df.persist(StorageLevel.DISK_ONLY))
    return _kept[-1]


def release_kept() -> None:
    """Free all kept rows; a result built on them computes them again."""
    while _kept:
        _kept.pop().unpersist()


def spread(df: DataFrame) -> DataFrame:
    """Give costly row work all cores where the input is too small to come in many splits.

    Goes by the size the optimizer expects, so nothing runs; anything larger than ``SMALL`` has splits enough and is
    never moved.
    """
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
