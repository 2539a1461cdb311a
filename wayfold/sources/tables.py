"""Table scans and appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A parquet table; filters and column choices on it go down to the file scan."""
    return spark.read.parquet(f"{root}/{table}.parquet")


def append_log(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a log; rows of one partition value are brought together first so a
    run writes few files, and AQE splits a value that is too large for one."""
    writer = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


#: Keys up to which a lookup hands them to the file reader.
PUSHED = 1000


def write_keyed(df: DataFrame, path: str, key: str, group_bytes: int = 128 << 20) -> None:
    """Write a table for lookups: sorted by key, so row groups have narrow bounds, with a Bloom filter of the key in each."""
    (df.repartitionByRange(key).sortWithinPartitions(key).write.option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option("parquet.block.size", group_bytes).parquet(path))


def lookup(spark: SparkSession, path: str, key: str, keys: DataFrame) -> DataFrame:
    """The rows of a keyed table whose key stands in ``keys``, by equi-join.

    Up to ``PUSHED`` keys also go to the reader as a filter, which skips row groups by their bounds and Bloom
    filters; of more keys it gets the lowest and highest, and Spark's runtime filter does the rest.
    """
    wanted = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    some = [r[0] for r in wanted.limit(PUSHED + 1).collect()]  # bounded
    rows = spark.read.parquet(path)
    if len(some) <= PUSHED:
        return rows.filter(F.col(key).isin(some)).join(F.broadcast(spark.createDataFrame([(k,) for k in some], wanted.schema)), key, "left_semi")
    low, high = wanted.agg(F.min(key), F.max(key)).first()
    return rows.filter(F.col(key).between(low, high)).join(wanted, key, "left_semi")


def first_row(spark: SparkSession, path: str, key: str, value) -> Row | None:
    """The one row of a key, null if there is none."""
    return spark.read.parquet(path).filter(F.col(key) == F.lit(value)).first()


class TenantTables:
    """The tables of some tenants, and no way to read any other row.

    Tables are partitioned by tenant; the scope is bound here once.  A list of tenants prunes folders
    when the query is planned, a table of tenants does when it runs.
    """

    def __init__(self, spark: SparkSession, root: str, tenants: Sequence | DataFrame, column: str = "tenant_id"):
        self.spark, self.root, self.column = spark, root, column
        self.tenants = tenants.select(column).distinct() if isinstance(tenants, DataFrame) else list(tenants)

    @staticmethod
    def write(df: DataFrame, root: str, table: str, column: str = "tenant_id") -> None:
        append_log(df, f"{root}/{table}", [column])

    def read(self, table: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/{table}")
        if isinstance(self.tenants, DataFrame):
            return rows.join(F.broadcast(self.tenants) if self._few() else self.tenants, self.column)
        return rows.filter(F.col(self.column).isin(self.tenants))

    def _few(self) -> bool:
        """Tenants so few that their table may be sent to every task."""
        return self.tenants.limit(PUSHED + 1).count() <= PUSHED
