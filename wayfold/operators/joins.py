"""Joins with a meaning of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null equals null; right key columns are dropped."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    match = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        match = eq if match is None else match & eq
    return left.join(r, match, how).drop(*[f"__r_{k}" for k in keys])


def or_key_flag(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], row_id: str,
                scope: Sequence[str], out: str) -> DataFrame:
    """Mark left rows met by the right side on any of several keys.

    One equi-join per key, united; a null key meets nothing.  Rows without a
    match get null, because absence of a record is not a negative finding.
    """
    hits = None
    for left_key, right_key in pairs:
        keys = right.filter(F.col(right_key).isNotNull()).select(
            *scope, F.col(right_key).alias("__k")).distinct()
        met = left.withColumn("__k", F.col(left_key)).join(keys, [*scope, "__k"], "left_semi").select(*scope, row_id)
        hits = met if hits is None else hits.unionByName(met)
    flags = hits.distinct().withColumn(out, F.lit(1.0))
    return left.join(flags, [*scope, row_id], "left")


def scoped_match(rows: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Rows whose address is suppressed for everyone or for their own tenant.

    Adds the first reason per row (global before tenant), null when free.
    """
    glob = (suppressions.filter(F.col("scope") == "GLOBAL").groupBy("value_hash")
            .agg(F.min("reason").alias("__g")))
    own = (suppressions.filter(F.col("scope") == "TENANT").groupBy("value_hash", "tenant_id")
           .agg(F.min("reason").alias("__t")))
    return (rows.join(glob, "value_hash", "left").join(own, ["value_hash", "tenant_id"], "left")
            .withColumn("suppression_reason", F.coalesce("__g", "__t")).drop("__g", "__t"))


def shared_members(rows: DataFrame, member: str, group: str, name: str,
                   scope: Sequence[str] = ()) -> DataFrame:
    """Members that occur in more than one group, as (group, name) rows."""
    shared = (rows.groupBy(*scope, member).agg(F.min(group).alias("__lo"), F.max(group).alias("__hi"))
              .filter(F.col("__lo") != F.col("__hi")).select(*scope, member))
    return rows.join(shared, [*scope, member], "left_semi").select(*scope, group, name).distinct()


def spec_join(keys: DataFrame, key: str, values: DataFrame, fields) -> DataFrame:
    """Every declared field for every key; a field nobody filled reads UNKNOWN."""
    spec = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("field"), F.lit(k).alias("kind"),
                              F.lit(r).alias("required")) for i, (n, k, r) in enumerate(fields)])
    wide = keys.select(key, F.explode(spec).alias("s")).select(key, "s.*")
    found = values.select(key, "field", "value", F.lit(True).alias("__known"))
    return (wide.join(found, [key, "field"], "left")
            .withColumn("known", F.coalesce("__known", F.lit(False)))
            .withColumn("display", F.coalesce("value", F.lit("UNKNOWN"))).drop("__known"))


def kinds_union(**frames: DataFrame) -> DataFrame:
    """Stack frames of one shape under a ``kind`` column."""
    out = None
    for kind, frame in frames.items():
        one = frame.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out
