"""Date and time against an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.text import col_of

DAY_MICROS = 86_400_000_000


def moment(value) -> Column:
    """A fixed time as a column; accepts ISO text, datetime or a column."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def parse_time(value) -> Column:
    return F.try_to_timestamp(col_of(value))


def parse_date_or_year(value) -> Column:
    """``YYYY-MM-DD`` or a bare year, which means its first day."""
    v = col_of(value)
    return F.try_to_timestamp(F.when(F.length(v) > 4, v).otherwise(F.concat(v, F.lit("-01-01"))))


def days_since(value, as_of) -> Column:
    return (F.unix_micros(moment(as_of)) - F.unix_micros(col_of(value))) / F.lit(float(DAY_MICROS))


def plus_days(value, days) -> Column:
    n = days if isinstance(days, Column) else F.lit(days)
    return moment(value) + F.make_dt_interval(n.cast("int"))


def is_past(value, as_of) -> Column:
    """Unknown is not past."""
    return F.coalesce(col_of(value) <= moment(as_of), F.lit(False))


def is_stale(stale_at, as_of) -> Column:
    return is_past(stale_at, as_of)


def review_is_due(next_review_at, as_of) -> Column:
    return col_of(next_review_at).isNull() | (col_of(next_review_at) <= moment(as_of))


def sweep_is_due(finished_at, as_of, stale_days: int) -> Column:
    return col_of(finished_at).isNull() | (days_since(finished_at, as_of) > stale_days)


def age_steps(days, steps, otherwise) -> Column:
    """Step function of age: first ``(limit, value)`` with days <= limit; null stays null."""
    d = col_of(days)
    chain = F.when(d.isNull(), F.lit(None).cast("double"))
    for limit, value in steps:
        chain = chain.when(d <= limit, F.lit(value))
    return chain.otherwise(F.lit(otherwise))


def activity_fit(days) -> Column:
    return age_steps(days, [(14, 1.0), (45, 0.8), (120, 0.5), (365, 0.25)], 0.0)


def freshness_fit(days) -> Column:
    return age_steps(days, [(7, 1.0), (30, 0.8), (90, 0.5)], 0.2)


def days_until(value, as_of, floor: int | None = None) -> Column:
    """Whole days from ``as_of`` to ``value``, half to even, optionally floored."""
    n = F.bround(-days_since(value, as_of)).cast("bigint")
    return n if floor is None else F.when(n.isNotNull(), F.greatest(F.lit(floor), n)).cast("bigint")
