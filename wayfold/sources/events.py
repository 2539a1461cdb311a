"""Event feeds as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DELIVERY = "event_id string, kind string, address string, target_id string, tenant_id string, event_time timestamp"


def delivery_feed(spark: SparkSession, path: str, schema: str = DELIVERY) -> DataFrame:
    """JSON delivery events as they land, new files first seen in a bounded number."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(path)


def parquet_feed(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
