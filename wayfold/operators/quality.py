"""Checks for what a database would enforce and files do not.

Each check returns the offending rows, so an empty frame is a pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose required reference is missing or points nowhere."""
    ids = parent.select(F.col(parent_key).alias(key))
    return df.join(ids, key, "left_anti")


def undisclosed_relations(services: DataFrame) -> DataFrame:
    """A commercial relation without a disclosure to show."""
    return services.filter((F.coalesce(F.col("relation"), F.lit("NONE")) != "NONE")
                           & (F.coalesce(F.length(F.trim("disclosure")), F.lit(0)) == 0))


UNIQUE_KEYS = {
    "campaign_target": ["campaign_id", "outlet_id"],
    "contact_method": ["tenant_id", "value_hash"],
    "coverage_event": ["tenant_id", "dedup_key"],
    "source_document": ["tenant_id", "url_hash", "campaign_id"],
    "promotion_service": ["tenant_id", "canonical_domain"],
    "profile_field": ["profile_id", "field"],
    "contact_evidence": ["contact_method_id", "evidence_id"],
}
