"""Newest, oldest and first-n rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_struct(order: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])


def _pick(df: DataFrame, keys: Sequence[str], order, values, newest: bool) -> DataFrame:
    values = list(values) if values is not None else [c for c in df.columns if c not in keys]
    chosen = F.struct(*[F.col(v) for v in values])
    fold = F.max_by if newest else F.min_by
    out = df.groupBy(*keys).agg(fold(chosen, order_struct(order)).alias("__row"))
    return out.select(*keys, *[F.col("__row")[v].alias(v) for v in values])


def newest_per_key(df: DataFrame, keys: Sequence[str], order, values=None) -> DataFrame:
    """One row per key, the last by ``order``; the map side keeps one row per key."""
    return _pick(df, keys, order, values, newest=True)


def oldest_per_key(df: DataFrame, keys: Sequence[str], order, values=None) -> DataFrame:
    return _pick(df, keys, order, values, newest=False)


def first_n_per_key(df: DataFrame, keys: Sequence[str], order, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key in ``order``.

    The filter on the rank lets Spark drop rows past ``n`` per key before the
    shuffle, so a hot key never travels whole.
    """
    by = [F.col(c).asc() if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def cap_edges(df: DataFrame, keys: Sequence[str], order: Sequence[str], cap: int, out: str) -> DataFrame:
    """Per key, the place in the order of its ``cap``-th row (or of its last one)."""
    head = first_n_per_key(df.select(*dict.fromkeys([*keys, *order])), keys, order, cap, "__rank")
    return head.groupBy(*keys).agg(F.max(order_struct(order)).alias(out))


def cap_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], cap: int,
                reason: str) -> DataFrame:
    """Mark the first ``cap`` rows per key; every other row stays, with a reason.

    The order must be unique within a key.  Only the row at the cap is looked up
    per key, so no task sorts a whole hot group.
    """
    edge = cap_edges(df, keys, order, cap, "__edge")
    inside = order_struct(order) <= F.col("__edge")
    return (df.join(edge, list(keys), "left")
            .withColumn("skipped", F.when(~inside, F.lit(reason)))
            .drop("__edge"))


def round_robin(df: DataFrame, scope: Sequence[str], family: str, order: Sequence[str],
                budget: int) -> DataFrame:
    """Interleave families, one item of each in turn, and keep ``budget`` items.

    An item at place k of its family has k - 1 items ahead of it, so places past
    the budget are cut before the shuffle without changing the answer.
    """
    head = first_n_per_key(df, [*scope, family], order, budget, "turn")
    return first_n_per_key(head, scope, ["turn", family], budget, "position")


def ordered_distinct(df: DataFrame, keys: Sequence[str], text: str, order) -> DataFrame:
    """First spelling of each text per key, compared without case or outer blanks."""
    folded = df.withColumn("__fold", F.lower(F.trim(F.col(text))))
    return oldest_per_key(folded, [*keys, "__fold"], order,
                          [c for c in df.columns if c not in keys]).drop("__fold")


def best_route(routes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Best active route per outlet: method rank, verified first, then oldest."""
    from wayfold import rules
    from wayfold.functions.text import lookup
    rank = F.coalesce(lookup("method", rules.ROUTE_RANK), F.lit(9))
    active = routes.filter(F.col("active"))
    return oldest_per_key(active, keys, [rank, F.col("verified_at").isNull(), *order])


def preferred_method(methods: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First sendable contact method per contact, else simply the first."""
    from wayfold import rules
    return oldest_per_key(methods, keys,
                          [~F.col("category").isin(rules.SENDABLE_CATEGORIES), *order])
