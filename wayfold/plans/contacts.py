"""Contacts: category, sendability, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import keys as ky
from wayfold.functions import text as tx
from wayfold.functions import web
from wayfold.operators.joins import scoped_match


def classify_contact(value: Column, page_class: Column, provider: Column, origin: Column,
                     independent: Column, hidden_only: Column, official: Column,
                     role: Column | None = None) -> Column:
    """Category of an address and why, as ``struct(category, reasons)``; first rung wins."""
    v = F.trim(F.coalesce(value, F.lit("")))
    local, domain = tx.email_local(v), tx.email_domain(v)
    role = tx.is_role_mailbox(local) if role is None else role
    free = tx.is_freemail(domain) & (tx.looks_personal(local) | ~role)
    mailbox = F.format_string("Role-based mailbox (%s@)", local)

    def rung(category: str, *reasons: Column | str) -> Column:
        listed = F.array_compact(F.array(*[r if isinstance(r, Column) else F.lit(r) for r in reasons]))
        return F.struct(F.lit(category).alias("category"), listed.alias("reasons"))

    linked = F.when(origin == "mailto-link", F.lit("Published as a mailto link, not scraped from prose"))
    backed = F.when(independent >= 2, F.format_string("Corroborated by %d independent source(s)", independent)) \
        .otherwise(F.lit("Published on the outlet's own domain"))
    on_page = F.format_string("Published on a %s page", F.lower(F.replace(page_class, F.lit("_"), F.lit(" "))))
    return (F.when(F.instr(v, "@") == 0, rung("UNKNOWN", "Not an email address"))
            .when(provider == "spotify", rung("SPOTIFY_ONLY_SOURCE",
                  "Found only through Spotify. Spotify data may not be used to resolve an outreach contact; "
                  "an independent professional source is required."))
            .when(hidden_only, rung("PROHIBITED_PRIVATE_INFORMATION",
                  "Address appears only in hidden markup — treated as a honeypot, never contacted."))
            .when(provider.isin("data_broker", "purchased_list"), rung("DATA_BROKER_SOURCE",
                  "Unlicensed contact list source — not usable."))
            .when(free, rung("PERSONAL_ADDRESS", F.format_string(
                "Free-mail domain (%s) with a personal-looking mailbox — treated as a personal address, "
                "not a business route.", domain)))
            .when(page_class == "SUBMISSION_GUIDELINES", rung("EXPLICIT_SUBMISSION_ROUTE",
                  "Published on a page whose purpose is music submissions", F.when(role, mailbox)))
            .when(role & (official | (independent >= 2)), rung("VERIFIED_PUBLIC_BUSINESS", mailbox, linked, backed))
            .when(role, rung("ROLE_BASED_ADDRESS", mailbox, linked))
            .when(page_class.isin(rules.BUSINESS_PAGE_CLASSES) & (independent >= 2), rung(
                "VERIFIED_PUBLIC_BUSINESS", on_page,
                F.format_string("Corroborated by %d independent domains", independent)))
            .when(page_class.isin(rules.BUSINESS_PAGE_CLASSES), rung(
                "UNVERIFIED_PUBLIC_BUSINESS", on_page, "Only one source has been seen so far"))
            .otherwise(rung("UNKNOWN", "Could not establish that this is a professional submission route")))


def methods_from_pages(records: DataFrame, key: bytes, provider: str = "open_web_fetch") -> DataFrame:
    """Contact methods of page records, hidden-only addresses included.

    ``position`` keeps the page's order; ``method_hash`` is the keyed hash that
    stands for the address everywhere else.
    """
    shown = F.transform("contacts", lambda c: F.lower(c["value"]))
    secret = F.array_sort(F.array_except(F.array_distinct(F.transform("hidden_emails", F.lower)), shown))
    row = ("value string, origin string, role_based boolean, hidden boolean")
    visible = F.transform("contacts", lambda c: F.struct(
        c["value"].alias("value"), c["origin"].alias("origin"), c["role_based"].alias("role_based"),
        F.lit(False).alias("hidden")))
    hidden = F.transform(secret, lambda v: F.struct(
        v.alias("value"), F.lit("hidden-markup").alias("origin"), F.lit(False).alias("role_based"),
        F.lit(True).alias("hidden")))
    typed = f"array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in row.split(','))}>>"
    each = records.select(
        "tenant_id", "url", "domain", "outlet_name", F.col("classification.label").alias("page_class"),
        F.coalesce("submissions.excerpt", "classification.excerpt").alias("excerpt"),
        F.posexplode(F.concat(visible.cast(typed), hidden.cast(typed))).alias("position", "c"))
    each = each.select("*", "c.*").drop("c")
    official = web.same_domain("value", "domain")
    judged = each.withColumn("judged", classify_contact(
        F.col("value"), F.col("page_class"), F.lit(provider), F.col("origin"), F.lit(1), F.col("hidden"),
        official, F.col("role_based")))
    return (judged.withColumn("category", F.col("judged.category")).withColumn("reasons", F.col("judged.reasons"))
            .drop("judged")
            .withColumn("method_hash", ky.keyed_hash("value", key))
            .withColumn("preview", tx.preview_email("value"))
            .withColumn("source_type", F.when(F.col("hidden"), "HIDDEN_MARKUP")
                        .when(official, "OFFICIAL").otherwise("THIRD_PARTY"))
            .withColumn("confidence", F.when(F.col("hidden"), 0.9)
                        .when(F.col("origin") == "mailto-link", 0.8).otherwise(0.5))
            .withColumn("independent_sources", F.when(F.col("hidden"), 0).otherwise(1)))


def fold_methods(methods: DataFrame, order) -> DataFrame:
    """One method per (tenant, address): the first category stays and may only
    strengthen; counts take the maximum."""
    from wayfold.operators.latest import order_struct
    from wayfold.operators.upsert import strengthen_category
    by = order_struct(order)
    rise = strengthen_category("UNVERIFIED_PUBLIC_BUSINESS", rules.SENDABLE_CATEGORIES)
    return methods.groupBy("tenant_id", "method_hash").agg(
        F.min_by("preview", by).alias("preview"), rise(F.col("category"), by).alias("category"),
        F.min_by("role_based", by).alias("role_based"),
        F.max("independent_sources").alias("independent_sources"),
        F.countDistinct(F.when(F.length("domain") > 0, F.col("domain"))).alias("independent_domains"),
        F.min_by(F.struct("domain", "outlet_name"), by).alias("organization"))


def honeypot_suppressions(methods: DataFrame) -> DataFrame:
    return methods.filter(F.col("hidden")).select(
        F.lit(None).cast("string").alias("tenant_id"), F.col("method_hash").alias("value_hash"),
        F.lit("GLOBAL").alias("scope"),
        F.lit("Honeypot: address published only in hidden markup").alias("reason")).distinct()


def sendability(methods: DataFrame, suppressions: DataFrame) -> DataFrame:
    """All reasons that keep an address from being mailed; none means sendable.

    ``methods`` needs tenant_id, value_hash, kind, category, restricted_only and
    independent_domains.
    """
    checked = scoped_match(methods, suppressions)
    blockers = F.array_compact(F.array(
        F.when(F.col("kind") != "EMAIL", F.format_string("%s routes are not sent by email", "kind")),
        F.when(F.col("restricted_only"), F.lit(
            "Address was found only through Spotify. Independent verification on a professional source "
            "outside Spotify is required before any email.")),
        F.when(~F.col("category").isin(rules.SENDABLE_CATEGORIES),
               F.format_string("Contact category %s is not eligible for direct email", "category")),
        F.when(F.col("suppression_reason").isNotNull(),
               F.format_string("Suppressed (%s) — permanently excluded", "suppression_reason")),
        F.when((F.col("category") == "UNVERIFIED_PUBLIC_BUSINESS")
               & (F.coalesce("independent_domains", F.lit(0)) < 2),
               F.lit("Business address is not independently verified"))))
    return checked.withColumn("blockers", blockers).withColumn("sendable", F.size("blockers") == 0)


def suppress(register: DataFrame, rows: DataFrame) -> DataFrame:
    """Register rows that are not in it yet; nothing is ever removed."""
    from wayfold.operators.upsert import insert_if_absent
    return insert_if_absent(register, rows, ["value_hash", "scope", "tenant_id"], ["reason"])
