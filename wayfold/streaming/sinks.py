"""Sinks that can be replayed.

Every micro-batch writes its own directory with overwrite, so a batch that is
run again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.latest import newest_per_key
from wayfold.operators.upsert import insert_if_absent


def change_log(path: str) -> Callable[[DataFrame, int], None]:
    """Keep the rows each batch emits (update mode) under their batch number."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return write


def current_state(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest emitted row per key."""
    return newest_per_key(spark.read.parquet(path), keys, ["batch"]).drop("batch")


def deltas(path: str, fold: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Keep what each batch adds, folded on its own, under its batch number.

    No state and no watermark: a row that comes late is added by the batch that brings it.
    """
    def write(rows: DataFrame, batch: int) -> None:
        fold(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return write


def summed(spark: SparkSession, path: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """All that the batches added, per key."""
    return spark.read.parquet(path).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


class Register:
    """Rows by key, each key once, in hash buckets with a Bloom filter per bucket.

    A batch reads the filters of its own buckets, and the rows of those buckets alone in which a
    filter does not rule all its keys out; most batches of new keys read no rows at all.  Filters are
    written before rows, so a batch that breaks off leaves at most set bits, and a replay replaces both.  A register that
    is not there yet is empty; any other read error stops the batch.
    """

    def __init__(self, path: str, schema: str, keys: Sequence[str], order: Sequence[str],
                 buckets: int = 1024, bits: int = 1 << 20, hashes: int = 4):
        self.path, self.schema, self.keys, self.order = path, schema, list(keys), list(order)
        self.buckets, self.bits, self.hashes = buckets, bits, hashes

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        one, two = F.xxhash64(F.lit(1), *self.keys), F.xxhash64(F.lit(2), *self.keys)
        places = F.array(*[F.pmod(F.shiftright(one, 20) + F.lit(k) * F.shiftright(two, 20), F.lit(self.bits)).cast("int") for k in range(self.hashes)])
        return rows.withColumns({"__key": one, "bucket": F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"), "__places": places})

    def _read(self, spark: SparkSession, part: str, schema: str, buckets: Sequence[int], batch: int) -> DataFrame:
        try:
            found = spark.read.schema(f"{schema}, batch int, bucket int").parquet(f"{self.path}/{part}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = spark.createDataFrame([], f"{schema}, batch int, bucket int")
        return found.filter(F.col("bucket").isin(list(buckets)) & (F.col("batch") != batch))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def maybe_known(self, fresh: DataFrame, batch: int) -> list[int]:
        """Buckets in which some key of the batch may be registered; at most ``buckets`` numbers."""
        spark = fresh.sparkSession
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
        filters = self._read(spark, "filters", "word int, bits long", touched, batch).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        asked = fresh.select("bucket", "__key", F.explode("__places").alias("place")).withColumn("word", F.shiftright("place", 6))
        is_set = F.coalesce(F.getbit("bits", F.col("place").bitwiseAND(63)), F.lit(0))
        per_key = asked.join(filters, ["bucket", "word"], "left").groupBy("bucket", "__key").agg(F.min(is_set).alias("all"))
        return [r[0] for r in per_key.filter(F.col("all") == 1).select("bucket").distinct().collect()]

    def known(self, fresh: DataFrame, batch: int) -> DataFrame:
        """The registered rows that a batch has to be held against."""
        return self._read(fresh.sparkSession, "rows", self.schema, self.maybe_known(fresh, batch), batch)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Append the batch's first row of each key that is not registered yet."""
        none = rows.sparkSession.createDataFrame([], self.schema)
        fresh = self._bucketed(insert_if_absent(none, rows.select(*none.columns), self.keys, self.order)).persist()
        try:
            have = self._bucketed(self.known(fresh, batch).select(*self.keys)).drop("bucket", "__places")
            have = have.select(F.col("__key").alias("__k"), *[F.col(k).alias(f"__k_{k}") for k in self.keys])
            same = fresh["__key"] == have["__k"]
            for k in self.keys:
                same = same & fresh[k].eqNullSafe(have[f"__k_{k}"])
            new = fresh.join(have, same, "left_anti")
            marks = (new.select("bucket", F.explode("__places").alias("place"))
                     .groupBy("bucket", F.shiftright("place", 6).alias("word"))
                     .agg(F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("bits")))
            for part, out in (("filters", marks), ("rows", new.drop("__key", "__places"))):
                out.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{part}/batch={batch}")
        finally:
            fresh.unpersist()


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str) -> list[dict]:
    """Process everything that has landed, then stop; the progress of every batch."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .foreachBatch(write).trigger(availableNow=True).start())
    query.awaitTermination()
    return list(query.recentProgress)
