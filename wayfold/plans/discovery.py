"""The discovery funnel: crawled pages to qualified targets, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import keys as ky
from wayfold.functions import web
from wayfold.functions.when import days_since, parse_date_or_year, parse_time
from wayfold.operators.joins import null_safe_join, or_key_flag
from wayfold.operators.latest import newest_per_key, oldest_per_key
from wayfold.plans import contacts, entities, page_facts, scoring
from wayfold.session import materialize


def verification_checks(rows: DataFrame) -> DataFrame:
    """What must hold before an opportunity qualifies, each as (key, ok, detail)."""
    def check(key, ok, detail):
        return F.struct(F.lit(key).alias("key"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))
    contact = F.when(F.size("blockers") > 0, F.try_element_at("blockers", F.lit(1))) \
        .when(F.col("has_method"), F.lit("Contact is independently verified")).otherwise(F.lit("No contact route"))
    return rows.withColumn("checks", F.array_compact(F.array(
        check("page_exists", F.col("fetch_status") == "OK", F.lit("Source page was retrieved successfully")),
        check("submissions_open", F.col("submissions_open") != "CLOSED",
              F.concat(F.lit("Submission state: "), "submissions_open")),
        check("recent", F.col("freshness_days").isNull() | (F.col("freshness_days") <= 365),
              F.concat(F.lit("Last dated activity: "), F.coalesce("freshness_date", F.lit("UNKNOWN")))),
        check("route_consistent", F.col("route_method").isNotNull() & (F.col("route_method") != "UNSUPPORTED"),
              F.concat(F.lit("Route: "), F.coalesce("route_method", F.lit("NONE")))),
        check("contact_verified", F.col("has_method") & F.col("sendable"), contact),
        F.when(F.col("has_method"), check("independently_sourced", F.col("evidence_count") >= 1, F.format_string(
            "%d evidence packet(s) support this address", "evidence_count"))))))


def crawl_records(pages: DataFrame) -> DataFrame:
    """Admitted pages of a crawl as a written table of page records.

    Everything after this step reads the table, so each page is parsed once.
    """
    return materialize(page_facts.page_records(pages.filter(web.block_reason("url").isNull())), "records")


def discover(records: DataFrame, campaigns: DataFrame, suppressions: DataFrame, relationships: DataFrame,
             coverage: DataFrame, key: bytes, as_of) -> DataFrame:
    """Page records of a crawl to scored, judged and qualified targets.

    ``records`` come from :func:`crawl_records` with tenant_id, campaign_id and seq;
    ``campaigns`` holds one row per campaign with its settings and profile values.
    The shuffles are: methods per address, owner per recipient key, and the lookups.
    """
    usable = records.filter((F.col("page_state") == "OK") & ~web.is_platform("domain"))
    base = newest_per_key(usable, ["tenant_id", "campaign_id", "url"], ["seq"])

    every = contacts.methods_from_pages(base, key)
    folded = contacts.fold_methods(every, ["url", "position"])
    register = suppressions.select("tenant_id", "value_hash", "scope", "reason").unionByName(
        contacts.honeypot_suppressions(every))
    judged = contacts.sendability(
        folded.withColumnRenamed("method_hash", "value_hash").withColumn("kind", F.lit("EMAIL"))
        .withColumn("restricted_only", F.lit(False)), register)
    sendable = every.filter(F.col("category").isin(rules.SENDABLE_CATEGORIES))
    chosen = oldest_per_key(sendable, ["tenant_id", "url"], ["position"], ["method_hash", "value"])
    # a page that several campaigns hold is one witness
    evidence = (every.select("tenant_id", "method_hash", "url", "position").distinct()
                .groupBy("tenant_id", "method_hash").agg(F.count("*").alias("evidence_count")))
    contact = (chosen.withColumnRenamed("method_hash", "value_hash")
               .join(judged.select("tenant_id", "value_hash", "sendable", "blockers", "suppression_reason",
                                   F.col("category").alias("contact_category"), "restricted_only"),
                     ["tenant_id", "value_hash"], "left")
               .join(evidence.withColumnRenamed("method_hash", "value_hash"), ["tenant_id", "value_hash"], "left")
               .withColumn("contact_domain", F.lower(F.substring_index("value", "@", -1))))

    texts = ["visible_text", "hidden_text", "whole_text", "links", "forms", "emails", "matches"]
    rows = base.drop(*texts).join(contact, ["tenant_id", "url"], "left").withColumn("has_method", F.col("value_hash").isNotNull())
    stated = F.col("freshness.date")
    rows = rows.withColumns({
        "route": entities.resolve_route(F.col("has_method"), F.lower(F.col("value"))), "outlet_id": ky.url_hash("url"),
        "kind": entities.outlet_kind(F.col("classification.label")), "submissions_open": F.col("submissions.state"),
        "freshness_date": stated, "freshness_days": days_since(parse_date_or_year(stated), as_of),
        "last_activity_at": F.when(F.length(stated) == 10, parse_time(stated)), "description": F.col("meta_description"),
        "organization_id": F.col("domain"), "cost_model": F.col("cost.model"), "cost_amount": F.col("cost.amount"),
        "fetch_status": F.lit("OK")})
    rows = verification_checks(rows.withColumns({
        "dedup_key": ky.recipient_key("value_hash", "domain", "outlet_id"), "route_method": F.col("route.method"),
        "route_login": F.col("route.requires_login"), "route_captcha": F.col("route.requires_captcha")}))
    # resolved targets are a table of their own, as every later step reads them
    owned = materialize(entities.owners(rows, ["campaign_id", "dedup_key"], "outlet_id", ["seq", "url"]), "targets")

    live = owned.filter(~F.col("is_duplicate"))
    live = or_key_flag(live, coverage.filter(F.col("artist_id").isNotNull()),
                       [("outlet_id", "outlet_id"), ("domain", "domain")], "outlet_id", ["tenant_id"], "peer_coverage")
    live = null_safe_join(live.withColumn("contact_id", F.col("value_hash")), relationships.select(
        "tenant_id", "contact_id", "outlet_id", "accepted_count", "declined_count", "placement_count",
        F.lit(True).alias("has_relationship")), ["tenant_id", "contact_id", "outlet_id"])
    none = F.lit(None).cast("string")
    live = live.join(campaigns.drop("tenant_id"), "campaign_id").withColumns({
        "requires_login": F.col("route_login"), "requires_captcha": F.col("route_captcha"),
        "follower_count": F.lit(None).cast("bigint"), "follower_count_source": none, "corroborating_domains": F.lit(1),
        "has_contact": F.col("has_method"), "territory": none, "outlet_domain": F.col("domain"), "send_stop": F.lit(False)})
    scored = scoring.assess_risk(scoring.score_opportunities(live, as_of), as_of)
    done = scoring.qualify(scoring.decide(scored))
    shape = ["tenant_id", "campaign_id", "outlet_id", "url", "domain", "outlet_name", "kind", "dedup_key",
             "owner_id", "members", "status", "rejection_reason", "score", "risk_score", "risk_band", "decision",
             "decision_reasons", "route_method", "reasons", "checks"]
    twins = owned.filter("is_duplicate").withColumn("status", F.lit("DUPLICATE")).withColumn(
        "rejection_reason", F.lit("Duplicate"))
    return done.select(*shape).unionByName(twins.select(*[c for c in shape if c in twins.columns]),
                                           allowMissingColumns=True)
