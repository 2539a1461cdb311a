"""Ordered scans over groups of any size, as distributed prefix scans.

A plain window would bring a whole group into one task.  Here rows are dealt to parts by
ranges of (keys, order), so every part holds a stretch of the order and about as many rows
as any other, whatever share a key has and even if all its rows have one time.  Each (part,
key) is folded to one summary row, the few summaries of a key are scanned, and what
came before a part is handed to it.  Only the key a part begins with can go on from an
earlier part: what is handed over is at most one row a part, which is what makes its
broadcast safe.  Inside a part the scan is a window over (key, part).

The dealt rows are kept on the executors' disks, so that the summaries and the rows see the
same parts; a lost block is computed again from the same ranges.  Nothing runs before the
result does.  ``session.release_kept()`` frees them when the results have been used.

Key columns hold no nulls here: a row without a key belongs to no group.
"""

from __future__ import annotations

import secrets
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.latest import order_struct
from wayfold.session import keep

PART = "__part"


def in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with the number of their part; parts follow each other in the order of (keys, order)."""
    # the random start gives every call rows of its own: Spark would else reuse those an earlier call kept of the same files
    number = F.spark_partition_id() + F.lit(secrets.randbits(48))
    return keep(df.repartitionByRange(*keys, *order).withColumn(PART, number))


def with_earlier(rows: DataFrame, keys: Sequence[str], summary: Column, fold, out: str) -> DataFrame:
    """Each row with ``fold`` over the summaries of its key's earlier parts, null where there are none."""
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    earlier = (rows.groupBy(*keys, PART).agg(summary.alias("__summary"))
               .withColumn(out, fold("__summary").over(before)).filter(F.col(out).isNotNull()))
    return rows.join(F.broadcast(earlier.drop("__summary")), [*keys, PART], "left")  # at most one row a part


def _inside(keys: Sequence[str], order: Sequence[str], last: int = 0):
    return Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` up to and including each row."""
    rows = with_earlier(in_parts(df, keys, order), keys, F.sum(value), F.sum, "__base")
    total = F.coalesce("__base", F.lit(0)) + F.sum(value).over(_inside(keys, order))
    return rows.withColumn(out, total).drop("__base", PART)


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
               include_current: bool = True) -> DataFrame:
    """Last non-null ``value`` at or before each row (strictly before on request)."""
    tail = F.max_by(value, F.when(F.col(value).isNotNull(), order_struct(order)))
    rows = with_earlier(in_parts(df, keys, order), keys, tail, lambda c: F.last(c, ignorenulls=True), "__base")
    here = F.last(value, ignorenulls=True).over(_inside(keys, order, 0 if include_current else -1))
    return rows.withColumn(out, F.coalesce(here, "__base")).drop("__base", PART)


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Value of the row before, nulls included (a ``lag`` that scales)."""
    boxed = df.withColumn("__box", F.struct(F.col(value).alias("v")))
    return (carry_last(boxed, keys, order, "__box", "__prev", include_current=False)
            .withColumn(out, F.col("__prev")["v"]).drop("__box", "__prev"))


def trailing_count(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, out: str) -> DataFrame:
    """Rows of the same key in the ``seconds`` up to each distinct time, ends included.

    Every arrival adds its count and, ``seconds`` later, takes it away again; the
    answer is a running total.  Arrivals at one time are folded first.
    """
    arrivals = df.groupBy(*keys, ts).agg(F.count("*").alias("arrived"))
    leaving = F.col(ts) + F.expr(f"INTERVAL {seconds} SECONDS")
    marks = arrivals.select(*keys, "arrived", F.inline(F.array(
        F.struct(F.col(ts).alias(ts), F.lit(0).alias("__leaves"), F.col("arrived").alias("__delta")),
        F.struct(leaving.alias(ts), F.lit(1).alias("__leaves"), (-F.col("arrived")).alias("__delta")))))
    total = running_total(marks, keys, [ts, "__leaves"], "__delta", out)
    return total.filter(F.col("__leaves") == 0).select(*keys, ts, "arrived", out)


def as_of_rows(df: DataFrame, keys: Sequence[str], ts: str, seq: str, asking: Column, answering: Column,
               values: Sequence[str], out: str) -> DataFrame:
    """The asking rows of a table, each with the newest answering row of its key at or before it, as a struct.

    Both sides come from one read of the table; a row may be on both.
    """
    sides = F.array_compact(F.array(F.when(answering, F.lit(0)), F.when(asking, F.lit(1))))
    rows = (df.withColumn("__side", F.explode(sides))
            .withColumn("__right", F.when(F.col("__side") == 0, F.struct(*[F.col(v) for v in values]))))
    seen = carry_last(rows, keys, [ts, "__side", seq], "__right", out)
    return seen.filter(F.col("__side") == 1).select(*df.columns, out)


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
               right_order: Sequence[str], values: Sequence[str], out: str) -> DataFrame:
    """Newest right row of the same key at or before each left row, as a struct."""
    payload = F.struct(*[F.col(v) for v in values])
    seq_type = dict(right.dtypes)[right_order[0]] if right_order else "bigint"
    lhs = left.select(*keys, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"),
                      F.lit(None).cast(seq_type).alias("__seq"), F.struct(*left.columns).alias("__left"),
                      F.lit(None).cast(_struct_type(right, values)).alias("__right"))
    rhs = right.select(*keys, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"),
                       (F.col(right_order[0]) if right_order else F.lit(0)).cast(seq_type).alias("__seq"),
                       F.lit(None).cast(_struct_type(left, left.columns)).alias("__left"),
                       payload.alias("__right"))
    seen = carry_last(lhs.unionByName(rhs), keys, ["__ts", "__side", "__seq"], "__right", out)
    return seen.filter(F.col("__side") == 1).select("__left.*", out)


def _struct_type(df: DataFrame, names: Sequence[str]) -> str:
    return df.select(F.struct(*[F.col(n) for n in names]).alias("s")).schema["s"].dataType.simpleString()
