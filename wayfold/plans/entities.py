"""Outlets, routes, targets, duplicates and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import text as tx
from wayfold.functions import web
from wayfold.operators.latest import oldest_per_key
from wayfold.operators.upsert import paired_with, upsert

OUTLET_RULES = {
    "submissions_open": "never_unknown",
    "follower_count": "last_known",
    "follower_count_source": paired_with("follower_count"),
    "created_at": "first",
}


def outlet_identity() -> Column:
    """(provider, external id) when the provider gives one, else the URL."""
    return F.when(F.length("external_id") > 0, F.concat_ws("|", F.lit("ext"), "provider", "external_id")) \
        .otherwise(F.concat_ws("|", F.lit("url"), "url"))


def upsert_outlets(base: DataFrame, changes: DataFrame, order: Sequence[str] = ("seq",), **more) -> DataFrame:
    """Outlet snapshot: a known open state is never lost, a missing follower count
    keeps the old one, the rest follows the newest read or a rule in ``more``."""
    return upsert(base, changes, ["tenant_id", "identity"], list(order), {**OUTLET_RULES, **more})


def outlet_kind(label: Column) -> Column:
    return F.when(label.isin(rules.OUTLET_KINDS), label).otherwise("CURATOR")


def resolve_route(has_sendable: Column, destination: Column) -> Column:
    """What the page really offers: email, captcha form, login, form, or nothing."""
    link = F.try_element_at(F.col("submission_links"), F.lit(1))["href"]

    def row(method: str, target: Column, login: bool, captcha: bool, note: Column) -> Column:
        return F.struct(F.lit(method).alias("method"), target.alias("destination"),
                        F.lit(login).alias("requires_login"), F.lit(captcha).alias("requires_captcha"),
                        note.alias("instructions"))
    said = F.col("submissions.excerpt")
    return (F.when(has_sendable, row("EMAIL", destination, False, False, said))
            .when(F.col("requires_captcha"), row("WEB_FORM", F.col("url"), False, True,
                                                 F.lit("CAPTCHA-protected form — human action required")))
            .when(F.col("requires_login"), row("LOGIN_REQUIRED", F.col("url"), True, False,
                                               F.lit("Login-walled submission — human action required")))
            .when(link.isNotNull(), row("WEB_FORM", link, False, False, said))
            .otherwise(row("UNSUPPORTED", F.col("url"), False, False,
                           F.lit("No published submission route found"))))


def owners(rows: DataFrame, keys: Sequence[str], row_id: str, order: Sequence[str]) -> DataFrame:
    """Every row with the earliest row of its key as ``owner_id``.

    Consolidated rows stay rows (owner, member) instead of a list per owner, so a
    key that holds a third of the data is never gathered in one place.
    """
    first = oldest_per_key(rows, keys, order, [row_id]).withColumnRenamed(row_id, "owner_id")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("members"))
    return (rows.join(first.join(sizes, list(keys)), list(keys))
            .withColumn("is_duplicate", F.col(row_id) != F.col("owner_id")))


def domain_fallback(targets: DataFrame, methods: DataFrame, order: Sequence[str]) -> DataFrame:
    """Owner by mailbox domain for ``domain:`` keys that no row owns.

    Off by default in the discovery plan: a target always owns its own key there.
    """
    mail = (targets.filter(F.col("status") != "DUPLICATE").join(
        methods.filter(F.col("domain").isNotNull()).select(
            "contact_id", web.registrable_domain("domain").alias("mail_domain")), "contact_id")
        .withColumn("fallback_key", F.concat(F.lit("domain:"), "mail_domain")))
    return oldest_per_key(mail, ["campaign_id", "fallback_key"], order, ["target_id"]).withColumnRenamed(
        "target_id", "owner_id")


def route_merges(routes: DataFrame, outlets: DataFrame) -> DataFrame:
    """Exact merges: same registrable domain and same address; smallest id wins."""
    open_rows = (routes.filter((F.col("method") == "EMAIL") & F.col("active") & (F.length("destination") > 0))
                 .join(outlets.filter(F.col("canonical_id").isNull())
                       .select("tenant_id", "outlet_id", "domain"), ["tenant_id", "outlet_id"])
                 .select("tenant_id", web.registrable_domain("domain").alias("site"), "destination", "outlet_id"))
    keys = ["tenant_id", "site", "destination"]
    winner = open_rows.groupBy(*keys).agg(F.min("outlet_id").alias("winner_id"))
    return (open_rows.distinct().join(winner, keys).filter(F.col("outlet_id") != F.col("winner_id"))
            .select("tenant_id", "destination", "winner_id", F.col("outlet_id").alias("loser_id")))


def name_suggestions(rows: DataFrame, scope: Sequence[str], row_id: str, name: str) -> DataFrame:
    """Rows that share a normalised name with another row: for a human, never applied."""
    keyed = rows.withColumn("name_key", tx.name_key(name)).filter(F.length("name_key") > 0)
    groups = (keyed.groupBy(*scope, "name_key").agg(F.count("*").alias("candidates"))
              .filter(F.col("candidates") > 1))
    return keyed.join(groups, [*scope, "name_key"]).select(*scope, "name_key", row_id, "candidates")


def recording_versions(recordings: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions as recordings: copied from their source with their own overrides."""
    own = ["version_type", "mix_name", "edit_name", "isrc", "explicit"]
    src = recordings.drop(*[c for c in own if c in recordings.columns])
    return (versions.join(src.withColumnRenamed("recording_id", "source_id"), "source_id")
            .withColumn("master_version", F.lit(False)).drop("source_id"))


def active_attestations(log: DataFrame, order: Sequence[str] = ("attested_at", "seq")) -> DataFrame:
    from wayfold.operators.latest import newest_per_key
    return newest_per_key(log.filter(F.col("revoked_at").isNull()), ["recording_id"], list(order))


def release_readiness(recordings: DataFrame, attested: DataFrame) -> DataFrame:
    """Seven yes/no checks per recording; unknown counts as not ready."""
    def filled(c: str) -> Column:
        return F.coalesce(F.length(F.col(c)) > 0, F.lit(False))
    joined = recordings.join(attested.select("recording_id", F.lit(True).alias("__r")).distinct(), "recording_id", "left")
    checks = {"isrc": filled("isrc"), "upc": filled("upc"),
              "distribution": F.coalesce("distributed", F.lit(False)), "rights": F.col("__r").isNotNull(),
              "writers": F.coalesce(F.size("writers") > 0, F.lit(False)), "publisher": filled("publisher"),
              "splits": F.coalesce("splits_confirmed", F.lit(False))}
    passed = sum((c.cast("int") for c in checks.values()), F.lit(0))
    return joined.select(
        "recording_id", passed.cast("bigint").alias("passed"), F.lit(len(checks)).cast("bigint").alias("total"),
        F.bround(passed / len(checks) * 100).cast("bigint").alias("score"),
        F.array_compact(F.array(*[F.when(~checks[k], F.lit(k)) for k in rules.RELEASE_CHECKS])).alias("missing"),
        (~checks["rights"]).alias("blocked"))


def coverage_events(records: DataFrame, watched: DataFrame, genres: DataFrame) -> DataFrame:
    """Receipted coverage: usable, non-platform pages that mention a watched name or a
    genre of the tenant.  No mention, no event."""
    from wayfold.functions.keys import coverage_key
    from wayfold.operators.containment import contains_join
    records = records.withColumn("folded_text", tx.fold("visible_text"))
    kind_of = lambda found: tx.first_label(F.col("title"), F.col("visible_text"), found, folded=F.col("folded_text"))
    usable = (records.filter((F.col("page_state") == "OK") & ~web.is_platform("domain"))
              .select("tenant_id", "url", "domain", "title", "visible_text", "retrieved_at", "seq",
                      kind_of(rules.TREND_RULES).alias("trend_kind"), kind_of(rules.COVERAGE_KIND_RULES).alias("coverage_kind")))
    names = watched.filter(F.col("active")).select(
        "tenant_id", "artist_id", F.col("name").alias("subject"), F.lit(None).cast("string").alias("genre_tag"))
    lanes = genres.select("tenant_id", F.lit(None).cast(dict(watched.dtypes)["artist_id"]).alias("artist_id"),
                          F.col("genre_tag").alias("subject"), "genre_tag")
    met = contains_join(usable, names.unionByName(lanes), ["url", "seq"], "visible_text", "subject", ["tenant_id"], excerpt_width=200)
    kind = F.when(F.col("artist_id").isNull(), F.col("trend_kind")).otherwise(F.col("coverage_kind"))
    return (met.withColumn("kind", kind)
            .withColumn("dedup_key", coverage_key("artist_id", "genre_tag", "url"))
            .withColumn("confidence", F.when(F.col("kind") != "UNKNOWN", 0.7).otherwise(0.5))
            .drop("trend_kind", "coverage_kind", "at"))


def fold_coverage(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """One event per key: first read describes it, an unknown kind may be filled once
    by the first clear one, the time is the newest read."""
    from wayfold.operators.latest import order_struct
    by = order_struct(order)
    known = F.min_by("kind", F.when(F.col("kind") != "UNKNOWN", by))
    return events.groupBy("tenant_id", "dedup_key").agg(
        F.coalesce(known, F.lit("UNKNOWN")).alias("kind"), F.min_by("url", by).alias("url"),
        F.max("retrieved_at").alias("retrieved_at"), F.count("*").alias("reads"))


def link_events(events: DataFrame, outlets: DataFrame, targets: DataFrame) -> DataFrame:
    """Coverage event to campaign target: outlet by URL first, else by domain."""
    by_url = oldest_per_key(outlets, ["tenant_id", "url"], ["outlet_id"], ["outlet_id"]) \
        .withColumnRenamed("outlet_id", "__u")
    by_site = oldest_per_key(outlets.filter(F.col("domain").isNotNull()), ["tenant_id", "domain"],
                             ["outlet_id"], ["outlet_id"]).withColumnRenamed("outlet_id", "__d")
    found = (events.join(by_url, ["tenant_id", "url"], "left").join(by_site, ["tenant_id", "domain"], "left")
             .withColumn("outlet_id", F.coalesce("__u", "__d")).drop("__u", "__d"))
    return found.join(targets.select("campaign_id", "outlet_id", "target_id"), "outlet_id", "left")
