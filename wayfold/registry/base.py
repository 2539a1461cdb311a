"""Registration and the mapping from the given tables to the domain's tables.

A binding is a list of plain expressions over one given table, readable by both
engines: Spark takes it as a select list, the checking SQL as a common table
expression.  Every binding covers its whole table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
TRADE_AS_OF = "2001-09-01 00:00:00"

REGISTRY: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    name: str
    rows: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def query(rows: str, sql: str | None = None, bindings: str = ""):
    """Register a function under its own name; ``rows`` names the survey rows it covers."""
    def add(fn):
        REGISTRY[fn.__name__] = Query(fn.__name__, rows, fn, with_bindings(sql, bindings) if sql else None)
        return fn
    return add


BINDINGS: dict[str, tuple[str, dict[str, str]]] = {
    "campaigns": ("customer", {
        "campaign_id": "c_custkey", "tenant_id": "CAST(c_nationkey AS BIGINT)", "name": "c_name",
        "mode": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'SCOUT' ELSE 'COPILOT' END",
        "status": "CASE c_mktsegment WHEN 'BUILDING' THEN 'DRAFT' WHEN 'HOUSEHOLD' THEN 'PAUSED' "
                  "WHEN 'FURNITURE' THEN 'COMPLETED' ELSE 'ACTIVE' END",
        "promotion_budget": "CASE WHEN c_acctbal >= 0 THEN c_acctbal * 100 END",
        "segment": "c_mktsegment"}),
    "targets": ("orders", {
        "target_id": "o_orderkey", "campaign_id": "o_custkey", "created_at": "CAST(o_orderdate AS TIMESTAMP)",
        "cost": "o_totalprice",
        "status": "CASE o_orderstatus "
                  "WHEN 'O' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'READY' WHEN '2-HIGH' THEN 'DRAFTED' "
                  "WHEN '3-MEDIUM' THEN 'APPROVED' WHEN '5-LOW' THEN 'DISCOVERED' ELSE 'QUALIFIED' END "
                  "WHEN 'P' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'SENT' WHEN '2-HIGH' THEN 'DELIVERED' "
                  "WHEN '3-MEDIUM' THEN 'RESPONDED' WHEN '5-LOW' THEN 'FOLLOW_UP_DUE' ELSE 'ACCEPTED' END "
                  "ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'DUPLICATE' WHEN '2-HIGH' THEN 'DISQUALIFIED' "
                  "WHEN '3-MEDIUM' THEN 'BOUNCED' WHEN '5-LOW' THEN 'BLOCKED' ELSE 'OPTED_OUT' END END"}),
    "score_log": ("lineitem", {
        "target_id": "l_orderkey", "outlet_id": "l_suppkey", "service_id": "l_partkey",
        "score": "CAST(l_quantity * 2 AS BIGINT)", "risk_score": "CAST(round(l_discount * 1000) AS BIGINT)",
        "decision": "CASE WHEN l_tax >= 0.07 THEN 'BLOCK' WHEN l_tax >= 0.05 THEN 'LEGAL_REVIEW' "
                    "WHEN l_tax >= 0.03 THEN 'DRAFT_ONLY' WHEN l_tax >= 0.01 THEN 'APPROVAL_REQUIRED' ELSE 'ALLOW' END",
        "created_at": "CAST(l_shipdate AS TIMESTAMP)",
        "seq": "CAST(l_linenumber AS BIGINT) * 1099511627776 + l_partkey",
        "amount": "l_extendedprice", "flag": "l_returnflag", "line": "l_linestatus"}),
    "outlets": ("supplier", {
        "outlet_id": "s_suppkey", "outlet_name": "s_name", "tenant_id": "CAST(s_nationkey AS BIGINT)",
        "follower_count": "CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal * 10) AS BIGINT) END",
        "balance": "s_acctbal"}),
    "services": ("part", {
        "service_id": "p_partkey", "name": "p_name", "brand": "p_brand", "kind": "p_type", "size": "CAST(p_size AS BIGINT)",
        "category": "CASE p_type WHEN 'PROMO' THEN 'PROMOTION_COMPANY' WHEN 'MEDIUM' THEN 'PLATFORM' "
                    "WHEN 'LARGE' THEN 'AD_PLATFORM' WHEN 'SMALL' THEN 'INDIVIDUAL_CURATOR' ELSE 'UNKNOWN' END",
        "pricing_min": "CASE WHEN p_size > 10 THEN p_retailprice END",
        "screening_status": "CASE WHEN p_size <= 5 THEN 'BLOCKED' WHEN p_size <= 15 THEN 'CAUTION' "
                            "WHEN p_size <= 30 THEN 'UNKNOWN' ELSE 'SCREENED' END"}),
    "log": ("events", {
        "event_id": "event_id", "ts": "CAST(ts AS TIMESTAMP)", "entity": "user_id", "type": "event_type",
        "value": "value", "props": "props"}),
    "docs": ("documents", {"doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"}),
    "turns": ("conversations", {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"}),
    "crawl": ("pages", {"page_id": "page_id", "url": "url", "html": "html"}),
}


def bound(spark: SparkSession, root: str, name: str) -> DataFrame:
    table, columns = BINDINGS[name]
    return spark.read.parquet(f"{root}/{table}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def with_bindings(sql: str, names: str) -> str:
    parts = []
    for name in names.split():
        table, columns = BINDINGS[name]
        parts.append(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table})")
    text = sql.strip()
    if not parts:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + text[len("WITH RECURSIVE"):].strip()
    if text.upper().startswith("WITH"):
        return "WITH " + ", ".join(parts) + ", " + text[4:].strip()
    return "WITH " + ", ".join(parts) + " " + text


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))
