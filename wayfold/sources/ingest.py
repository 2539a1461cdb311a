"""User-entered rows: optional values stay null, never empty or zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import text as tx

TEXT = ["title", "isrc", "iswc", "upc", "publisher"]
LISTS = ["writers", "producers", "alternate_titles", "reporting_platforms"]
FLAGS = ["distributed", "splits_confirmed"]


def track_rows(raw: DataFrame) -> DataFrame:
    """Text columns of an add-track form to typed catalog columns."""
    rest = [c for c in raw.columns if c not in {*TEXT, *LISTS, *FLAGS, "streams", "monthly_streams"}]
    return raw.select(
        *rest, *[tx.clean_text(c).alias(c) for c in TEXT], *[tx.comma_list(c).alias(c) for c in LISTS],
        *[tx.tri_state(c).alias(c) for c in FLAGS], tx.separated_integer("streams").alias("streams"),
        tx.integer_list("monthly_streams").alias("monthly_streams"))


def profile_value(kind: str | Column, value: str | Column) -> Column:
    """One profile entry as text by its declared kind; empty or bad input is null."""
    k, v = tx.col_of(kind), tx.clean_text(value)
    parts = F.array_join(tx.comma_list(value), ", ")
    number = v.try_cast("double")
    shown = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    flag = F.when(F.lower(v).isin("1", "true", "yes", "on", "explicit"), "Yes").otherwise("No")
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(k == "list", F.when(F.length(parts) > 0, parts))
            .when(k == "number", shown).when(k == "bool", flag).otherwise(v))
