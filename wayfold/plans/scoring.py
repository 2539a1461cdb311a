"""Opportunity score, risk, compliance decision, qualification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import score as sc
from wayfold.functions import text as tx
from wayfold.functions.when import activity_fit, days_since, freshness_fit, parse_date_or_year


def opportunity_components(as_of) -> dict[str, Column]:
    """Component expressions over one joined row per target."""
    profile = F.array_compact(F.concat(F.array(F.col("primary_genre")), F.coalesce(
        "secondary_genres", F.array().cast("array<string>"))))
    moods = F.concat(F.coalesce("mood", F.array().cast("array<string>")),
                     F.coalesce("playlist_contexts", F.array().cast("array<string>")))
    context = F.concat(F.coalesce("genres", F.array().cast("array<string>")),
                       F.when(F.length("description") > 0, F.array("description"))
                       .otherwise(F.array().cast("array<string>")))
    return {
        "genre_fit": sc.overlap(profile, "genres"),
        "microgenre_fit": sc.overlap("microgenres", "genres"),
        "context_fit": sc.overlap(moods, context),
        "territory_fit": sc.territory_fit("territory", "territories"),
        "audience_fit": sc.audience_fit("follower_count", "follower_count_source"),
        "opportunity_activity": activity_fit(days_since("last_activity_at", as_of)),
        "credibility": sc.credibility("organization_id", "url", "description", "corroborating_domains"),
        "submission_availability": sc.submission_fit("route_method", "submissions_open", "requires_login", "requires_captcha"),
        "contact_verification": sc.contact_fit("has_contact", "sendable", "contact_category"),
        "relationship_history": sc.relationship_fit("has_relationship", "accepted_count", "declined_count", "placement_count"),
        "peer_coverage": F.col("peer_coverage"),
        "cost_efficiency": sc.cost_fit("cost_model", "cost_amount"),
        "freshness": freshness_fit("freshness_days"),
    }


def score_opportunities(rows: DataFrame, as_of) -> DataFrame:
    """Score every target; adds the components, score and reasons."""
    parts = opportunity_components(as_of)
    wide = rows.withColumns({f"c_{k}": v for k, v in parts.items()})
    named = {k: F.col(f"c_{k}") for k in parts}
    weights = {name: w for name, w, *_ in rules.OPPORTUNITY_COMPONENTS}
    return (wide.withColumn("score", sc.weighted_score([(named[k], weights[k]) for k in weights], empty=0))
            .withColumn("components", F.create_map(*[x for k in weights for x in (F.lit(k), named[k])]))
            .withColumn("reasons", sc.opportunity_reasons(named)).drop(*[f"c_{k}" for k in parts]))


def score_overrides(scores: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual scores are log rows; the newest row per target wins as always."""
    valid = overrides.filter(F.col("score").between(0, 100) & (F.length(F.trim("reason")) > 0))
    manual = valid.select("target_id", "score", "created_at", "seq", F.lit(True).alias("human_override"))
    return scores.select("target_id", "score", "created_at", "seq", F.lit(False).alias("human_override")).unionByName(manual)


def assess_risk(rows: DataFrame, as_of) -> DataFrame:
    """Risk of a page record: distinct signals, capped sum, band."""
    label = F.col("classification.label")
    words = F.lower(F.concat_ws(" ", F.coalesce("classification.excerpt", F.lit("")), F.coalesce("title", F.lit(""))))
    age = days_since(parse_date_or_year("freshness.date"), as_of)
    category = F.col("contact_category") if "contact_category" in rows.columns else F.lit(None).cast("string")

    def any_of(phrases) -> Column:
        return words.rlike("|".join(phrases))
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(
        F.when(label == "GUARANTEED_STREAMS", F.lit("guaranteed_streams")),
        F.when(label == "GUARANTEED_PLACEMENT", F.lit("guaranteed_placement")),
        F.when(any_of(rules.ARTIFICIAL_STREAMING_PHRASES), F.lit("artificial_streaming_language")),
        F.when(any_of(rules.UNREALISTIC_PHRASES), F.lit("unrealistic_claims")),
        F.when((F.col("cost.model") == "PAID_CONSIDERATION") & (F.coalesce("cost.amount", F.lit(0.0)) == 0),
               F.lit("unexplained_payment")),
        F.when(F.size("injection_findings") > 0, F.lit("injection_attempt")),
        F.when((F.size("hidden_emails") > 0) | F.coalesce(category == "PROHIBITED_PRIVATE_INFORMATION", F.lit(False)),
               F.lit("honeypot_contact")),
        F.when(F.col("submissions.state") == "UNKNOWN", F.lit("missing_submission_terms")),
        F.when(F.coalesce(F.length("outlet_name") == 0, F.lit(True)) | (F.col("outlet_name") == F.col("domain")),
               F.lit("unclear_ownership")),
        F.when(age > 730, F.lit("stale_presence"))))))
    return (rows.withColumn("risk_signals", found).withColumn("risk_score", sc.risk_score("risk_signals"))
            .withColumn("risk_band", sc.risk_band("risk_score")))


def outreach_category(category: Column, cost_model: Column, known_partner: Column) -> Column:
    return (F.when(known_partner, "EXISTING_RELATIONSHIP")
            .when(cost_model == "PAID_CONSIDERATION", "PAID_CONSIDERATION")
            .when(cost_model == "ADVERTISING_OR_SPONSORSHIP", "SPONSORSHIP_OR_ADVERTISING")
            .when(category == "EXPLICIT_SUBMISSION_ROUTE", "PUBLISHED_SUBMISSION_ADDRESS")
            .when(category.isin("ROLE_BASED_ADDRESS", "VERIFIED_PUBLIC_BUSINESS"), "COLD_PROFESSIONAL_OUTREACH")
            .otherwise("UNKNOWN"))


def decide(rows: DataFrame) -> DataFrame:
    """Compliance decision: the most restrictive outcome of any rule, with every reason.

    ``rows`` needs has_method, restricted_only, contact_category, suppression_reason,
    sendable, blockers, risk_band, risk_score, cost_model, accepted_count,
    placement_count, territory, contact_domain, outlet_domain, sender_ready, mode and
    send_stop.
    """
    sev = rules.DECISION_SEVERITY
    partner = (F.coalesce("accepted_count", F.lit(0)) + F.coalesce("placement_count", F.lit(0))) > 0
    has = F.coalesce("has_method", F.lit(False))
    wide = (rows.withColumn("recipient_country", sc.infer_country("territory", F.coalesce("contact_domain", "outlet_domain")))
            .withColumn("rule_set", sc.rule_set("recipient_country"))
            .withColumn("outreach_category", outreach_category(F.coalesce("contact_category", F.lit("UNKNOWN")),
                                                               F.col("cost_model"), partner)))

    def rule(when: Column, decision: str, reason: Column | str) -> Column:
        text = reason if isinstance(reason, Column) else F.lit(reason)
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(sev[decision]).alias("s"), text.alias("reason")))

    def is_category(name: str) -> Column:
        return has & (F.col("contact_category") == name)
    hard = [
        rule(has & F.col("restricted_only"), "BLOCK", "Address was found only through Spotify. Spotify data may not be "
             "used to resolve an outreach contact."),
        rule(has & F.col("suppression_reason").isNotNull(), "BLOCK",
             F.format_string("Recipient is suppressed (%s)", "suppression_reason")),
        rule(is_category("PROHIBITED_PRIVATE_INFORMATION"), "BLOCK", "Address is prohibited private information"),
        rule(is_category("PERSONAL_ADDRESS"), "BLOCK", "Personal addresses are never used for outreach"),
        rule(is_category("DATA_BROKER_SOURCE"), "BLOCK", "Address came from an unlicensed contact list"),
    ]
    first = F.array_compact(F.array(rule(~has, "DRAFT_ONLY", "No contact method resolved — this opportunity has no "
                                         "email route"), *hard))
    blocked_early = F.exists(first, lambda r: r["s"] == sev["BLOCK"])
    unsendable = F.when(has & ~F.coalesce("sendable", F.lit(True)) & ~blocked_early, F.transform(
        "blockers", lambda b: F.struct(F.lit(sev["DRAFT_ONLY"]).alias("s"), b.alias("reason")))).otherwise(
        F.array().cast("array<struct<s:int,reason:string>>"))
    rest = F.array_compact(F.array(
        rule(F.col("risk_band") == "BLOCK", "BLOCK", F.format_string("Risk score %d — blocked", "risk_score")),
        rule(F.col("risk_band") == "HIGH RISK", "LEGAL_REVIEW",
             F.format_string("Risk score %d — legal review required", "risk_score")),
        rule(F.col("risk_band") == "REVIEW", "APPROVAL_REQUIRED",
             F.format_string("Risk score %d — human review required", "risk_score")),
        rule(F.col("outreach_category") == "PAID_CONSIDERATION", "APPROVAL_REQUIRED",
             "Paid consideration — explicit spend approval required, and a fee never implies placement"),
        rule(F.col("outreach_category") == "SPONSORSHIP_OR_ADVERTISING", "LEGAL_REVIEW",
             "Advertising or sponsorship must be reviewed and disclosed"),
        rule(F.col("cost_model").isin("GUARANTEED_PLACEMENT", "GUARANTEED_STREAMS"), "BLOCK", F.format_string(
            "%s offers are blocked outright", F.initcap(F.replace("cost_model", F.lit("_"), F.lit(" "))))),
        rule(F.col("recipient_country").isNull(), "APPROVAL_REQUIRED",
             "Recipient country is UNKNOWN — the most restrictive rule set applies"),
        rule(F.col("rule_set").isin("EU", "UK"), "ALLOW", "EU/UK rules: first contact must identify the sender, state "
             "where the address was found, and honour an objection immediately"),
        rule(F.col("rule_set") == "CA", "ALLOW", "CASL: implied consent expires — re-contact limits are enforced"),
        rule(F.col("rule_set") == "US", "ALLOW", "CAN-SPAM: postal address and a working opt-out are required"),
        rule(~F.coalesce("sender_ready", F.lit(True)), "DRAFT_ONLY",
             "Sender health has not passed — outreach is drafts only"),
        rule(F.col("mode") == "SCOUT", "DRAFT_ONLY", "Scout mode never sends")))
    stop = F.coalesce("send_stop", F.lit(False))
    fired = F.when(stop, F.array(F.struct(F.lit(sev["BLOCK"]).alias("s"), F.lit("Emergency send stop is engaged").alias("reason")))) \
        .otherwise(F.concat(first, unsendable, rest))
    worst = F.greatest(F.lit(sev["APPROVAL_REQUIRED"]), F.coalesce(F.array_max(F.transform("fired", lambda r: r["s"])), F.lit(0)))
    return (wide.withColumn("fired", fired)
            .withColumn("decision", sc.by_severity(worst, sev))
            .withColumn("decision_reasons", F.transform("fired", lambda r: r["reason"])).drop("fired")
            .withColumn("lawful_basis", tx.lookup("rule_set", rules.LAWFUL_BASIS))
            .withColumn("permission_signal", tx.lookup("contact_category", rules.PERMISSION_SIGNAL)))


def qualify(rows: DataFrame) -> DataFrame:
    """Final status: blocked, closed, below threshold, needs a human, or ready."""
    human = F.coalesce(F.col("route_method").isin("LOGIN_REQUIRED", "WEB_FORM", "UNSUPPORTED"), F.lit(False)) \
        | F.col("decision").isin("DRAFT_ONLY", "LEGAL_REVIEW")
    score = F.coalesce("score", F.lit(0))
    return rows.withColumn(
        "status", F.when(F.col("decision") == "BLOCK", "BLOCKED").when(F.col("submissions_open") == "CLOSED", "DISQUALIFIED")
        .when(score < rules.QUALIFICATION_THRESHOLD, "DISQUALIFIED").when(human, "QUALIFIED").otherwise("READY")
    ).withColumn(
        "rejection_reason", F.when(F.col("decision") == "BLOCK", F.when(
            F.col("risk_band").isin("BLOCK", "HIGH RISK"), "Suspicious route").otherwise("Invalid contact"))
        .when(F.col("submissions_open") == "CLOSED", "Submissions closed")
        .when(score < rules.QUALIFICATION_THRESHOLD, "Not a genre fit"))
