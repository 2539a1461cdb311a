"""Stream forms of the event operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions.keys import keyed_hash

SUPPRESSION = "tenant_id string, value_hash string, scope string, reason string"
SUPPRESSION_KEY = ["value_hash", "scope", "tenant_id"]


def once(events: DataFrame, at: str = "event_time", lateness: str = "1 day") -> DataFrame:
    """Drop repeats of an event id inside the lateness window; state stays bounded.

    Rows later than the window are dropped too: for volumes only, never before a keyed register.
    """
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["event_id"])


def delivery_outcomes(events: DataFrame) -> DataFrame:
    """What a delivery event means: suppression reason and response kind, null if none."""
    kind = F.col("kind")
    reason = (F.when(kind.isin(rules.BOUNCE_EVENTS), "Permanent bounce").when(kind.isin(rules.COMPLAINT_EVENTS), "Spam complaint")
              .when(kind.isin(rules.OPT_OUT_EVENTS), "Opt-out requested by recipient"))
    response = F.when(F.col("target_id").isNotNull(), F.when(kind.isin(rules.BOUNCE_EVENTS), "BOUNCE").when(
        kind.isin(rules.OPT_OUT_EVENTS), "OPT_OUT"))
    return events.withColumns({"reason": reason, "response_kind": response,
                               "result": F.when(reason.isNotNull(), "SUPPRESSED").otherwise("IGNORED")})


def suppression_rows(outcomes: DataFrame, key: bytes) -> DataFrame:
    """Global suppression rows of judged events, for the register sink."""
    return outcomes.filter(F.col("reason").isNotNull()).select(
        F.lit(None).cast("string").alias("tenant_id"), keyed_hash("address", key).alias("value_hash"), F.lit("GLOBAL").alias("scope"), "reason")


def response_rows(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("response_kind").isNotNull()).select(
        "target_id", F.col("response_kind").alias("kind"), "event_id", "event_time")


def send_volume(sends: DataFrame, keys: Sequence[str], at: str = "sent_at",
                width: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Trailing sends per key in sliding windows (start).  Of one batch it is what the batch adds, however late its rows are."""
    return (sends.groupBy(F.window(at, width, slide), *keys)
            .agg(F.count("*").alias("sends")).select(F.col("window.start").alias("start"), *keys, "sends"))
