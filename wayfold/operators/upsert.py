"""Snapshot maintenance on plain files: upsert, delete, retention."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.labels import Labels, other_labels, with_others
from wayfold.operators.latest import order_struct

Rule = str | Labels | Callable[[Column, Column], Column]
#: The union of lists whose labels are not known beforehand.
UNION = Labels(())


def _fold(name: str, rule: Rule, order: Column) -> Column:
    value = F.col(name)
    known = F.when(value.isNotNull(), order)
    if callable(rule):
        return rule(value, order)
    if rule == "last":
        return F.max_by(value, order)
    if rule == "last_known":
        return F.max_by(value, known)
    if rule == "first":
        return F.min_by(value, order)
    if rule == "first_known":
        return F.min_by(value, known)
    if rule == "max":
        return F.max(value)
    if rule == "min":
        return F.min(value)
    if rule == "sum":
        return F.sum(value)
    if rule == "any":
        return F.bool_or(value)
    if isinstance(rule, Labels):
        return rule.known(value)
    if rule == "never_unknown":
        return F.coalesce(F.max_by(value, F.when(value.isNotNull() & (value != "UNKNOWN"), order)),
                          F.lit("UNKNOWN"))
    raise ValueError(f"unknown merge rule {rule!r}")


def paired_with(marker: str) -> Callable[[Column, Column], Column]:
    """Keep a column in step with ``marker``: take it from the newest row where the
    marker is known (a count and the source that stated it, for example)."""
    return lambda value, order: F.max_by(value, F.when(F.col(marker).isNotNull(), order))


def strengthen_category(weak: str, strong: Sequence[str]) -> Callable[[Column, Column], Column]:
    """First category stays, except that ``weak`` may rise to the first strong one."""
    def rule(value: Column, order: Column) -> Column:
        first = F.min_by(value, order)
        rise = F.min_by(value, F.when(value.isin(list(strong)), order))
        return F.when(first == weak, F.coalesce(rise, first)).otherwise(first)
    return rule


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str],
           rules: dict[str, Rule]) -> DataFrame:
    """Merge an ordered change log into a snapshot, one merge rule per column.

    The snapshot is simply the oldest change, so the whole merge is one grouped
    aggregation: one shuffle, folded on the map side, null-safe on the keys.
    Columns without a rule take the newest value.  Lists are united by :class:`Labels`; labels outside
    its vocabulary are a narrow aggregation of their own.
    """
    columns = [c for c in base.columns if c not in keys]
    old = base.withColumn("__age", F.lit(0))
    for name in order:
        if name not in old.columns:
            old = old.withColumn(name, F.lit(None).cast(dict(changes.dtypes)[name]))
    new = changes.withColumn("__age", F.lit(1))
    both = old.unionByName(new, allowMissingColumns=True)
    by = order_struct(["__age", *order])
    out = both.groupBy(*keys).agg(*[_fold(c, rules.get(c, "last"), by).alias(c) for c in columns])
    for name, rule in rules.items():
        if isinstance(rule, Labels) and not rule.closed:
            out = with_others(out, other_labels(both, keys, name, rule, "__others"), keys, name)
    return out.select(*base.columns)


def upsert_buckets(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int = 256) -> None:
    """Put the newest row per key into a table kept in hash buckets, rewriting only the buckets that the rows fall in.

    ``rows`` holds the table's columns, the order's among them.  The new content of those buckets is written apart first, so
    nothing is overwritten while it is read, and a run that breaks off can be repeated; a repeat changes nothing.
    """
    from wayfold.operators.latest import newest_per_key
    from wayfold.session import materialize
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = newest_per_key(rows, keys, list(order)).withColumn("bucket", bucket)
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        old = spark.createDataFrame([], new.schema)
    new = materialize(new, "bucket-rows")
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    both = old.filter(F.col("bucket").isin(touched)).unionByName(new)
    merged = materialize(newest_per_key(both, [*keys, "bucket"], list(order)), "bucket-content")
    (merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))


def insert_if_absent(base: DataFrame, rows: DataFrame, keys: Sequence[str],
                     order: Sequence[str]) -> DataFrame:
    """Append rows whose key is new; the first of equal new keys wins."""
    from wayfold.operators.latest import oldest_per_key
    fresh = oldest_per_key(rows, keys, order)
    match = None
    renamed = base.select(*[F.col(k).alias(f"__b_{k}") for k in keys])
    for k in keys:
        eq = fresh[k].eqNullSafe(renamed[f"__b_{k}"])
        match = eq if match is None else match & eq
    return base.unionByName(fresh.join(renamed, match, "left_anti").select(*base.columns))


def drop_expired(documents: DataFrame, policies: DataFrame, as_of) -> DataFrame:
    """Retention: drop rows older than their provider's window; no window keeps them."""
    from wayfold.functions.when import days_since
    windows = policies.select("provider", "retention_days")
    aged = documents.join(windows, "provider", "left")
    expired = ((F.coalesce(F.col("retention_days"), F.lit(0)) > 0)
               & F.coalesce(days_since("created_at", as_of) > F.col("retention_days"), F.lit(False)))
    return aged.filter(~expired).select(*documents.columns)


def forget_provider(documents: DataFrame, evidence: DataFrame,
                    provider: str) -> tuple[DataFrame, DataFrame]:
    """Delete one provider's documents and evidence; loosen references to them."""
    gone = documents.filter(F.col("provider") == provider).select(
        F.col("id").alias("source_document_id"), F.lit(True).alias("__gone"))
    kept_docs = documents.filter(~F.col("provider").eqNullSafe(F.lit(provider)))
    loose = (evidence.filter(~F.col("source_type").eqNullSafe(F.lit(provider.upper())))
             .join(gone, "source_document_id", "left")
             .withColumn("source_document_id", F.when(F.col("__gone").isNull(), F.col("source_document_id")))
             .select(*evidence.columns))
    return kept_docs, loose
