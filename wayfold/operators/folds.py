"""Folds of append-only logs into current state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions.score import by_severity, severity
from wayfold.operators.latest import order_struct
from wayfold.operators.scans import carry_last, previous_value


def severity_fold(df: DataFrame, keys: Sequence[str], label: str, table: dict, out: str) -> DataFrame:
    """Most severe label per key; rules never cancel each other."""
    worst = df.groupBy(*keys).agg(F.max(severity(label, table)).alias("__s"))
    return worst.select(*keys, by_severity("__s", table).alias(out))


def tri_state_fold(claims: DataFrame, keys: Sequence[str], value: str = "value",
                   confidence: str = "confidence") -> DataFrame:
    """Fold boolean claims per key: better confidence wins, a tie between opposite
    values is unknown and flagged."""
    yes = F.max(F.when(F.col(value), F.col(confidence)))
    no = F.max(F.when(~F.col(value), F.col(confidence)))
    best = claims.groupBy(*keys).agg(yes.alias("__yes"), no.alias("__no"))
    y, n = F.col("__yes"), F.col("__no")
    return best.select(
        *keys,
        F.when(y.isNotNull() & n.isNotNull() & (y == n), F.lit(None).cast("boolean"))
        .when(y.isNotNull() & (n.isNull() | (y > n)), F.lit(True))
        .when(n.isNotNull(), F.lit(False)).alias("state"),
        (y.isNotNull() & n.isNotNull() & (y == n)).alias("conflict"))


def current_batch(packets: DataFrame, keys: Sequence[str], order: Sequence[str],
                  batch: str = "content_hash", read_at: str = "retrieved_at") -> DataFrame:
    """Rows of the newest read of each URL.

    The newest row names the batch; its rows share the read time and, when the
    newest row has one, the content hash.
    """
    newest = packets.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(batch).alias("b"), F.col(read_at).alias("r")),
                 order_struct(order)).alias("__new"))
    joined = packets.join(newest, list(keys))
    same_time = F.col(read_at).eqNullSafe(F.col("__new.r"))
    same_hash = F.col("__new.b").isNull() | F.col(batch).eqNullSafe(F.col("__new.b"))
    return joined.filter(same_time & same_hash).drop("__new")


def content_changes(reads: DataFrame, keys: Sequence[str], order: Sequence[str], digest: str) -> DataFrame:
    """Flag reads whose content differs from the read before (both known)."""
    seen = previous_value(reads, keys, order, digest, "previous_hash")
    return seen.withColumn("changed", F.coalesce(F.col("previous_hash") != F.col(digest), F.lit(False)))


def effective_status(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Status in force: a newest override stands; a newest automated verdict may
    only tighten the newest override before it."""
    by = order_struct(order)
    table = rules.SCREENING_SEVERITY
    now = log.groupBy(*keys).agg(
        F.max_by(F.struct("status", "human_override"), by).alias("__new"),
        F.max_by("status", F.when(F.col("human_override"), by)).alias("__held"))
    tightened = F.greatest(severity(F.col("__new.status"), table), severity(F.col("__held"), table))
    return now.select(*keys, F.when(F.col("__new.human_override"), F.col("__new.status"))
                      .otherwise(by_severity(tightened, table)).alias("effective_status"),
                      F.col("__new.status").alias("newest_status"), F.col("__held").alias("override_status"))


def effective_history(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The status in force after every row of the log."""
    table = rules.SCREENING_SEVERITY
    marked = log.withColumn("__o", F.when(F.col("human_override"), F.col("status")))
    held = carry_last(marked, keys, order, "__o", "override_status")
    worse = F.greatest(severity("status", table), severity("override_status", table))
    return held.withColumn("effective_status", F.when(F.col("human_override"), F.col("status"))
                           .otherwise(by_severity(worse, table))).drop("__o")


def target_status(responses: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Target status after the newest response."""
    from wayfold.functions.text import lookup
    moved = responses.withColumn("__status", lookup("kind", rules.RESPONSE_STATUS))
    return moved.groupBy(*keys).agg(F.max_by("__status", order_struct(order)).alias("status"))


def plan_state(log: DataFrame, keys: Sequence[str], order: Sequence[str], at: str) -> DataFrame:
    """Plan items from their status log.

    The payment time is set by the first payment after the last refund and is
    never moved by later statuses.
    """
    by = order_struct(order)
    marks = log.groupBy(*keys).agg(
        F.max_by("status", by).alias("status"),
        F.max(F.when(F.col("status") == "REFUNDED", by)).alias("__refund"))
    paid = (log.filter(F.col("status") == "PAID").join(marks.select(*keys, "__refund"), list(keys))
            .filter(F.col("__refund").isNull() | (by > F.col("__refund")))
            .groupBy(*keys).agg(F.min_by(at, by).alias("paid_at")))
    return marks.drop("__refund").join(paid, list(keys), "left")


def field_state(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Profile fields from their event log: an empty entry deletes the field, a human
    entry is never replaced by a derived one."""
    by = order_struct(order)
    empty = F.col("value").isNull() & F.col("human")
    deleted = log.groupBy(*keys).agg(F.max(F.when(empty, by)).alias("__gone"))
    alive = log.filter(F.col("value").isNotNull()).join(deleted, list(keys)).filter(
        F.col("__gone").isNull() | (by > F.col("__gone")))
    return alive.groupBy(*keys).agg(
        F.max_by("value", F.struct(F.col("human"), by)).alias("value"),
        F.bool_or("human").alias("human_override"))


def recontact_state(log: DataFrame, keys: Sequence[str], order: Sequence[str], at: str) -> DataFrame:
    """Relationship counters and the next date a message is acceptable.

    ``log.kind`` is one of TOUCH, ACCEPT, DECLINE, PLACE, OPT_OUT; the newest row
    sets the waiting time.
    """
    from wayfold.functions.text import lookup
    days = F.coalesce(lookup("kind", rules.RECONTACT_DAYS), F.lit(rules.RECONTACT_DAYS["TOUCH"]))
    folded = log.withColumn("__days", days).groupBy(*keys).agg(
        F.max_by(F.struct(F.col(at).alias("at"), F.col("__days").alias("d")), order_struct(order)).alias("__n"),
        F.count_if(F.col("kind") == "ACCEPT").alias("accepted_count"),
        F.count_if(F.col("kind") == "DECLINE").alias("declined_count"),
        F.count_if(F.col("kind") == "PLACE").alias("placement_count"))
    return folded.select(*keys, "accepted_count", "declined_count", "placement_count",
                         F.col("__n.at").alias("last_contact_at"),
                         (F.col("__n.at") + F.make_dt_interval(F.col("__n.d"))).alias("next_eligible_at"))
