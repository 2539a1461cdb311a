"""The dossier of a target: one wide row from all its logs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.when import is_stale


@dataclass(frozen=True)
class Log:
    """Rows of one kind: ``at`` and ``seq`` order them, ``values`` are shown.

    ``shown`` is how many of the newest are kept; 0 keeps the newest alone, as a struct instead of a list.
    Logs that are kinds of rows of one table name the same ``rows`` and say by ``where`` which are theirs.
    """

    rows: DataFrame
    at: str
    seq: str
    values: tuple[str | Column, ...]
    shown: int = 0
    where: Column | None = None


@dataclass(frozen=True)
class Kind:
    """A log that is some rows of a table with others, and its columns made of that table's."""

    rows: DataFrame
    where: Column
    columns: dict[str, Column]


def _field_of_each(items: Column, name: str) -> Column:
    return F.transform(items, lambda x: x[name])


def wide_rows(spine: DataFrame, key: str, logs: dict[str, Log]) -> DataFrame:
    """Each spine row with, per log, its newest row or its ``shown`` newest ones and ``<log>_count``.

    All tables and the spine are one union that moves once, by the key; a row that belongs to several logs
    moves once too, as the columns it has, and values are made of those that are shown.  In its place each key is a
    stream of rows from the newest on, where a row's place in a log is a running count, and a list never grows past its
    bound: the rest is counted, not held.
    """
    tables: dict[tuple, dict[str, Log]] = {}
    for name, log in logs.items():
        tables.setdefault((id(log.rows), log.at, log.seq), {})[name] = log
    parts = [spine.select(F.col(key), F.struct(*[c for c in spine.columns if c != key]).alias("__spine"))]
    for place, ((_, at, seq), kinds) in enumerate(tables.items()):
        rows = next(iter(kinds.values())).rows
        named = [v for log in kinds.values() for v in log.values]
        used = [c for c in rows.columns if c in named] if all(isinstance(v, str) for v in named) else [c for c in rows.columns if c != key]
        parts.append(rows.select(F.col(key), F.col(at).cast("timestamp").alias("__at"), F.col(seq).cast("bigint").alias("__seq"), F.struct(*used).alias(f"__row_{place}"), *[
            (F.lit(True) if log.where is None else F.coalesce(log.where, F.lit(False))).alias(f"__in_{name}") for name, log in kinds.items()]))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition(key)
    newest = Window.partitionBy(key).orderBy(F.desc("__at"), F.desc("__seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = union.withColumns({f"__place_{name}": F.count_if(F.col(f"__in_{name}")).over(newest) for name in logs})
    for place, kinds in enumerate(tables.values()):
        own = [c for c in ranked.columns if c != f"__row_{place}"]
        shown = {name: F.col(f"__in_{name}") & (F.col(f"__place_{name}") <= max(log.shown, 1)) for name, log in kinds.items()}
        ranked = ranked.select(*own, f"__row_{place}.*").select(*own, *[
            F.when(shown[name], F.struct(*log.values)).alias(f"__of_{name}") for name, log in kinds.items()])
    aggs: list[Column] = [F.max_by("__spine", F.col("__spine").isNotNull()).alias("__spine"), F.bool_or(F.col("__spine").isNotNull()).alias("__known")]
    for name, log in logs.items():
        value = F.col(f"__of_{name}")
        if log.shown:
            listed = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(f"__place_{name}").alias("__place"), value.alias(name)))))
            aggs.append(_field_of_each(listed, name).alias(name))
        else:
            aggs.append(F.first(value, ignorenulls=True).alias(name))
        aggs.append(F.count_if(F.col(f"__in_{name}")).alias(f"{name}_count"))
    wide = ranked.groupBy(key).agg(*aggs).filter("__known")
    return wide.select(key, "__spine.*", *[c for n in logs for c in (n, f"{n}_count")])


def target_dossiers(targets: DataFrame, outlets: DataFrame, campaigns: DataFrame, scores: DataFrame, risks: DataFrame, decisions: DataFrame,
                    drafts: DataFrame, submissions: DataFrame, responses: DataFrame, placements: DataFrame, evidence: DataFrame,
                    methods: DataFrame, as_of, shown: int = 5) -> DataFrame:
    """Everything a reviewer sees of a target, one row each.

    Newest score, risk, decision, draft and contact method; the ``shown`` newest submissions, responses, placements and
    receipts, each with the number there are; the outlet and the campaign's mode.  All logs
    carry target_id, created_at and seq; a log may be a :class:`Kind` of a table with others.
    """
    def log(source: DataFrame | Kind, *values: str, shown: int = 0, **more: Column) -> Log:
        made = {**(source.columns if isinstance(source, Kind) else {}), **more}
        shaped = ("created_at", *[made[v].alias(v) if v in made else v for v in values])
        return Log(source.rows, "created_at", "seq", shaped, shown, source.where) if isinstance(source, Kind) else Log(source, "created_at", "seq", shaped, shown)
    stale = is_stale(evidence.columns["stale_at"] if isinstance(evidence, Kind) else F.col("stale_at"), as_of)
    wide = wide_rows(targets.select("target_id", "campaign_id", "outlet_id", "status", "created_at"), "target_id", {
        "score": log(scores, "score", "reasons"), "risk": log(risks, "risk_score", "signals"), "decision": log(decisions, "decision", "reasons"),
        "draft": log(drafts, "subject", "payload_hash"), "method": log(methods, "category", "sendable"),
        "submissions": log(submissions, "method", shown=shown), "responses": log(responses, "kind", shown=shown),
        "placements": log(placements, "value", shown=shown),
        "receipts": log(evidence, "supports_field", "value", "source_domain", "confidence", "stale", shown=shown, stale=stale)})
    about = wide.join(campaigns.select("campaign_id", F.col("name").alias("campaign_name"), "mode"), "campaign_id", "left")
    return about.join(outlets.select("outlet_id", "outlet_name", "follower_count"), "outlet_id", "left")
