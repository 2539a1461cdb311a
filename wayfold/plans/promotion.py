"""Paid services: evidence, facts, screening, campaign fit, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import score as sc
from wayfold.functions import text as tx
from wayfold.functions import web
from wayfold.functions.when import days_since, is_past, is_stale, plus_days
from wayfold.operators.folds import tri_state_fold
from wayfold.operators.labels import Labels
from wayfold.operators.latest import newest_per_key, oldest_per_key, order_struct
from wayfold.plans import page_facts

VALUE = ("signal string, label string, field string, value boolean, category string, service_types array<string>, "
         "genres array<string>, login_walled boolean, min double, max double, currency string, model string, "
         "terms_url string, contact_url string, name string")


def _value(**given: Column) -> Column:
    fields = [part.strip().split(" ", 1) for part in VALUE.split(", ")]
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def page_packets(records: DataFrame) -> DataFrame:
    """Every signal, fact, price and link of a service's page with its passage.

    ``records`` come from ``page_records(..., offers=True)`` with service_id, and with the service's
    known pricing_url where there is one.
    """
    whole, text = F.col("whole_text"), F.col("visible_text")
    known = F.col("pricing_url") if "pricing_url" in records.columns else F.lit(None).cast("string")
    low = F.col("__low")
    base = (page_facts.with_declared_links(records).withColumn("__low", tx.fold(whole))
            .withColumn("category", tx.first_label(None, whole, rules.CATEGORY_RULES, folded=low))
            .withColumn("types", tx.all_labels(whole, rules.SERVICE_TYPE_RULES, low))
            .withColumn("wall", F.when(F.col("prices").isNull(), page_facts.price_login_wall(
                whole, text, F.col("requires_login"), F.col("url"), known))))
    # the passage that names the category, or else the first service type
    named = [F.when(F.col("category") == label, F.lit(pattern)) for label, pattern in rules.CATEGORY_RULES]
    typed = [F.when(F.array_contains("types", label), F.lit(pattern)) for label, pattern in rules.SERVICE_TYPE_RULES]
    kind = F.when(F.col("declared.terms_url").isNotNull(), F.lit("terms")).otherwise(F.lit("contact"))
    linked = F.when(F.contains(F.lower(whole), kind), kind)

    def packet(field: Column | str, value: Column, excerpt: Column, confidence) -> Column:
        return F.struct((field if isinstance(field, Column) else F.lit(field)).alias("supports_field"),
                        value.alias("value"), excerpt.cast("string").alias("excerpt"),
                        (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"))
    signals = F.transform("signals", lambda s: packet(
        "stream_guarantees", _value(signal=s["signal"], label=s["label"]), s["excerpt"], 0.9))
    facts = F.transform("facts", lambda f: packet(
        F.coalesce(tx.lookup(f["field"], rules.FACT_SUPPORTS), F.lit("business_model")),
        _value(field=f["field"], value=f["value"], label=f["label"]), f["excerpt"], f["confidence"]))
    title = F.col("title")
    single = F.array_compact(F.array(
        F.when((F.col("category") != "UNKNOWN") | (F.size("types") > 0), packet(
            "business_model", _value(category=F.col("category"), service_types=F.col("types"), genres=F.col("genres")),
            tx.excerpt_around(whole, F.coalesce(*named, *typed), 180), 0.6)),
        F.when(F.col("wall").isNotNull(), packet("pricing", _value(login_walled=F.lit(True)), F.col("wall"), 0.7)),
        F.when(F.col("prices").isNotNull(), packet("pricing", _value(
            min=F.col("prices.min"), max=F.col("prices.max"), currency=F.col("prices.currency"),
            model=F.col("prices.model")), F.col("prices.excerpt"), 0.7)),
        F.when(F.col("declared.terms_url").isNotNull() | F.col("declared.contact_url").isNotNull(), packet(
            "terms", _value(terms_url=F.col("declared.terms_url"), contact_url=F.col("declared.contact_url")),
            F.coalesce(tx.excerpt_around(whole, linked, 180), F.substring(text, 1, 200)), 0.6)),
        F.when(F.length(title) > 0, packet("company_identity", _value(name=F.substring(title, 1, 120)),
                                           F.substring(title, 1, 200), 0.6))))
    keep = [c for c in ("tenant_id", "service_id", "url", "domain", "content_hash", "retrieved_at", "seq") if c in base.columns]
    return (base.select(*keep, F.posexplode(F.concat(signals, facts, single)).alias("part", "p"))
            .select(*keep, "part", "p.*").withColumnRenamed("url", "source_url")
            .withColumn("excerpt", tx.bounded_excerpt("excerpt")))


def important(packets: DataFrame) -> DataFrame:
    """Packets whose change on a page is worth a human's look."""
    return packets.filter(F.col("supports_field").isin(rules.IMPORTANT_SUPPORTS))


def register_services(records: DataFrame, known: DataFrame) -> DataFrame:
    """Service per (tenant, domain): known ones stay, a new one needs an offer page.

    ``known(tenant_id, domain, service_id)`` is already resolved through merges.
    """
    offers = records.filter((F.col("page_state") == "OK") & ~web.is_platform("domain")
                            & page_facts.is_offer_page(F.col("whole_text")))
    first = oldest_per_key(offers, ["tenant_id", "domain"], ["seq"], ["outlet_name", "url"])
    fresh = (first.join(known, ["tenant_id", "domain"], "left_anti")
             .select("tenant_id", "domain", F.sha2(F.concat_ws("|", "tenant_id", "domain"), 256).alias("service_id"),
                     F.coalesce("outlet_name", "domain").alias("name"), "url"))
    return known.select("tenant_id", "domain", "service_id").withColumn("is_new", F.lit(False)).unionByName(
        fresh.select("tenant_id", "domain", "service_id", F.lit(True).alias("is_new")))


def claims_of(packets: DataFrame, keys) -> DataFrame:
    """Boolean claims: stated facts plus the field each hard-block signal settles."""
    facts = packets.filter(F.col("value.field").isNotNull()).select(
        *keys, F.col("value.field").alias("field"), F.col("value.value").alias("value"), "confidence")
    signals = first_signals(packets, keys, ["seq"]).select(
        *keys, tx.lookup("signal", rules.SIGNAL_FIELDS).alias("field"), F.lit(True).alias("value"),
        F.lit(0.9).alias("confidence"))
    return facts.unionByName(signals.filter(F.col("field").isNotNull()))


def first_signals(packets: DataFrame, keys, order) -> DataFrame:
    """First packet per hard-block signal of a service."""
    rows = packets.filter((F.col("supports_field") == "stream_guarantees") & (F.length("value.signal") > 0)) \
        .withColumn("signal", F.col("value.signal"))
    return oldest_per_key(rows, [*keys, "signal"], order, ["value", "excerpt", "source_url"]).select(
        *keys, "signal", F.coalesce("value.label", "signal").alias("label"), "excerpt", "source_url")


def recompute_facts(packets: DataFrame, keys=("service_id",), order=("seq",)) -> DataFrame:
    """Facts of each service from its current packets."""
    keys, by = list(keys), order_struct(order)
    folded = tri_state_fold(claims_of(packets, keys), [*keys, "field"])
    tri = folded.groupBy(*keys).pivot("field", rules.TRISTATE_FIELDS).agg(F.first("state"))
    flags = folded.groupBy(*keys).agg(F.bool_or(F.when(F.col("field").isin(rules.TRISTATE_FIELDS), F.col("conflict"))).alias("conflict"))
    v = F.col("value")
    model = F.col("supports_field") == "business_model"
    priced = (F.col("supports_field") == "pricing") & v["min"].isNotNull()

    def first(value: Column, when: Column) -> Column:
        return F.min_by(value, F.when(when & value.isNotNull(), by))

    types, genres = (Labels(known, closed=True) for known in ([label for label, _ in rules.SERVICE_TYPE_RULES], rules.GENRES))
    other = packets.groupBy(*keys).agg(
        F.coalesce(first(v["category"], model & (v["category"] != "UNKNOWN")), F.lit("UNKNOWN")).alias("category"),
        types.known(F.when(model, v["service_types"])).alias("service_types"),
        genres.known(F.when(model, v["genres"])).alias("supported_genres"),
        F.coalesce(first(v["model"], priced), F.lit("UNKNOWN")).alias("pricing_model"),
        F.min(F.when(priced, v["min"])).alias("pricing_min"),
        F.max(F.when(priced, F.coalesce(v["max"], v["min"]))).alias("pricing_max"),
        first(v["currency"], priced).alias("pricing_currency"),
        F.max(F.when(priced, F.col("retrieved_at"))).alias("pricing_last_verified_at"),
        F.bool_or(F.coalesce(v["login_walled"], F.lit(False))).alias("pricing_login_walled"),
        first(v["terms_url"], F.lit(True)).alias("terms_url"), first(v["contact_url"], F.lit(True)).alias("contact_url"),
        first(v["name"], F.lit(True)).alias("company_name"))
    out = other.join(tri, keys, "left").join(flags, keys, "left")
    return out.withColumn("manual_review_required", F.coalesce("conflict", F.lit(False))).drop("conflict").withColumn(
        "business_model_summary", business_model_summary())


def business_model_summary() -> Column:
    """One clause per established fact, null when there is none."""
    def short(c: str) -> Column:
        x = F.col(c)
        return F.when(x == F.floor(x), F.format_string("%d", x.cast("bigint"))).otherwise(x.cast("string"))
    currency = F.coalesce("pricing_currency", F.lit(""))
    one = F.concat(F.trim(F.concat(F.lit("Published price: "), short("pricing_min"), F.lit(" "), currency)), F.lit("."))
    span = F.concat(F.trim(F.concat(F.lit("Published prices run "), short("pricing_min"), F.lit("–"),
                                    short("pricing_max"), F.lit(" "), currency)), F.lit("."))
    text = F.concat_ws(
        " ", tx.lookup("category", rules.BUSINESS_MODEL_TEXT),
        F.when(F.col("pricing_model") == "FREE_SUBMISSION", F.lit("Submissions are free — no submission fee."))
        .when(F.col("pricing_min").isNotNull(), F.when(F.col("pricing_min") == F.col("pricing_max"), one).otherwise(span)),
        F.when(F.col("placement_discretionary"), F.lit("Placement stays at the curator's discretion.")),
        F.when(F.col("guaranteed_feedback"), F.lit("A listen or written reply is guaranteed.")),
        F.when(F.col("guaranteed_coverage"), F.lit("Coverage itself is sold as the product.")))
    return F.when(F.length(text) > 0, text)


def rescreen_window(status: str | Column) -> Column:
    return F.coalesce(tx.lookup(status, rules.RESCREEN_DAYS), F.lit(rules.RESCREEN_DAYS["UNKNOWN"]))


def fact_freshness(packets: DataFrame, services: DataFrame, as_of, keys=("service_id",)) -> DataFrame:
    """Is every packet behind each fact inside the service's re-read window?"""
    keys = list(keys)
    rows = packets.join(services.select(*keys, "screening_status"), keys, "left")
    fresh = days_since("retrieved_at", as_of) <= rescreen_window("screening_status")
    return (rows.groupBy(*keys, F.coalesce("value.field", "supports_field").alias("fact"))
            .agg(F.bool_and(F.coalesce(fresh, F.lit(False))).alias("fresh"))
            .groupBy(*keys).agg(F.bool_and("fresh").alias("all_fresh")))


def screening_inputs(services: DataFrame) -> DataFrame:
    """What screening may see.  Commercial relation and disclosure are not selected,
    so they cannot enter the decision."""
    seen = ["service_id", "name", "canonical_domain", "company_name", "category", "service_types", "pricing_model",
            "pricing_min", "pricing_max", "pricing_currency", "business_model_summary", "terms_url", "contact_url",
            "page_ok_count", "manual_review_required", "all_fresh", "pricing_login_walled", "signal_labels",
            "policy_stale", *rules.TRISTATE_FIELDS]
    return services.select(*[c for c in seen if c in services.columns])


def screening_components() -> dict[str, Column]:
    none = F.lit(None).cast("double")
    found = F.length("terms_url") > 0
    contact = F.length("contact_url") > 0
    named = (F.length("company_name") > 0) | (F.length("name") > 0)
    return {
        "company_identity": F.when(named & (F.coalesce(found, F.lit(False)) | F.coalesce(contact, F.lit(False))), 1.0),
        "business_model_transparency": F.when(F.length("business_model_summary") > 0, 1.0),
        "pricing_transparency": F.when(F.col("pricing_min").isNotNull() | (F.col("pricing_model") == "FREE_SUBMISSION"), 1.0),
        "placement_independence": sc.tri_value("placement_discretionary"),
        "anti_bot_policy": sc.tri_value("anti_bot_policy"),
        "curator_vetting": sc.tri_value("curator_vetting"),
        "playlist_vetting": sc.tri_value("playlist_vetting"),
        "terms_clarity": F.when(found, 1.0),
        "refund_clarity": sc.tri_value("refund_policy"),
        "evidence_freshness": sc.tri_value("all_fresh"),
        "policy_compatibility": none,
        "risk_signals": F.when(F.size("signal_labels") > 0, 0.0),
    }


def screen(inputs: DataFrame) -> DataFrame:
    """The ladder: blocked, caution, unknown, screened; every reason is named."""
    def when(cond: Column, text: str | Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), text if isinstance(text, Column) else F.lit(text))
    category = F.col("category")
    price = F.col("pricing_min").isNotNull()
    caution = F.array_compact(F.array(
        when(F.col("guaranteed_coverage"), "Coverage is sold as a product — paid media needs disclosure clarity"),
        when(F.col("curator_compensation"), "Curators are paid per placement"),
        when(F.col("refund_policy").isNull() & price, "No refund policy found while pricing is published"),
        when(category.isin(rules.VETTING_RELEVANT) & F.col("curator_vetting").isNull(),
             "Curator vetting not evidenced for a curator marketplace"),
        when(category.isin(rules.VETTING_RELEVANT) & F.col("playlist_vetting").isNull(),
             "Playlist vetting not evidenced for a curator marketplace"),
        when(F.col("manual_review_required"), "Flagged for manual review"),
        when(F.col("policy_stale") & category.isin(rules.PLACEMENT_RELEVANT),
             "Platform policy evidence is out of date — compatibility uncertain")))
    identity = ((F.length("name") > 0) & (F.length("canonical_domain") > 0)
                & (F.coalesce(F.length("terms_url") > 0, F.lit(False)) | F.coalesce(F.length("contact_url") > 0, F.lit(False))))
    unmet = F.array_compact(F.array(
        when(category.isin(rules.PLACEMENT_RELEVANT) & ~F.coalesce("placement_discretionary", F.lit(False)),
             "placement discretion not evidenced"),
        when(~price & (F.col("pricing_model") != "FREE_SUBMISSION"), F.when(
            F.coalesce("pricing_login_walled", F.lit(False)), "pricing is behind a login — login-walled pages are not read")
            .otherwise("pricing unavailable")),
        when(F.coalesce(F.length("business_model_summary"), F.lit(0)) == 0, "business model not established from evidence"),
        when(~F.coalesce(identity, F.lit(False)), "no terms or contact page found"),
        when(F.coalesce("page_ok_count", F.lit(0)) < 2, "fewer than two pages of this service could be read"),
        when(~F.col("all_fresh"), "evidence stale")))
    met = F.array(F.lit("No guarantee evidence found in this service's own pages"),
                  F.when(F.coalesce("placement_discretionary", F.lit(False)), "Placement stays with the curator")
                  .otherwise("Placement discretion not applicable to this category"),
                  F.lit("Pricing is published"), F.lit("Business model assembled from evidence"),
                  F.lit("Company identity and terms or contact page found"))
    parts = screening_components()
    weights = [(parts[k], w) for k, w in rules.SCREENING_COMPONENTS]
    hollow = [i for i, (k, _) in enumerate(rules.SCREENING_COMPONENTS) if k == "evidence_freshness"]
    out = inputs.withColumn("__caution", caution).withColumn("__unmet", unmet)
    blocked = F.size("signal_labels") > 0
    status = (F.when(blocked, "BLOCKED").when(F.size("__caution") > 0, "CAUTION")
              .when(F.size("__unmet") > 0, "UNKNOWN").otherwise("SCREENED"))
    return (out.withColumn("status", status)
            .withColumn("reasons", F.when(blocked, F.col("signal_labels")).when(F.size("__caution") > 0, F.col("__caution"))
                        .when(F.size("__unmet") > 0, F.col("__unmet")).otherwise(met))
            .withColumn("block_reason", F.when(blocked, F.concat(
                F.array_join("signal_labels", "; "), F.lit(" — found in this service's own offer pages."))))
            .withColumn("score", sc.covered_score(weights, hollow))
            .withColumn("coverage", F.bround(sc.known_weight(weights) * 100).cast("bigint"))
            .drop("__caution", "__unmet"))


def screen_services(packets: DataFrame, services: DataFrame, page_counts: DataFrame, policy_stale: bool, as_of) -> DataFrame:
    """Current packets to verdicts for all services at once.

    ``packets`` is read several times, so it should be a written evidence table.
    """
    facts = recompute_facts(packets)
    fresh = fact_freshness(packets, services, as_of)
    signals = (first_signals(packets, ["service_id"], ["seq"]).groupBy("service_id")
               .agg(F.array_sort(F.collect_set("label")).alias("signal_labels")))
    joined = (services.select("service_id", "name", "canonical_domain").join(facts, "service_id", "left")
              .join(fresh, "service_id", "left").join(signals, "service_id", "left")
              .join(page_counts, "service_id", "left")
              .withColumn("signal_labels", F.coalesce("signal_labels", F.array().cast("array<string>")))
              .withColumn("policy_stale", F.lit(policy_stale)))
    return screen(screening_inputs(joined))


def campaign_fit(pairs: DataFrame) -> DataFrame:
    """Fit of service and campaign on one joined row per pair."""
    genres = F.array_compact(F.concat(F.array("primary_genre"), F.coalesce("secondary_genres", F.array().cast("array<string>")),
                                      F.coalesce("microgenres", F.array().cast("array<string>"))))
    channels = F.transform("service_types", tx.channel_of)
    parts = {
        "genre_overlap": sc.overlap(genres, "supported_genres"),
        "territory_overlap": sc.overlap("territories", "supported_territories"),
        "language_match": F.when(F.length("language") > 0, sc.overlap(F.array("language"), "supported_languages")),
        "channel_match": sc.overlap("channels", channels),
        "goal_match": sc.overlap("priorities", "service_types"),
        "budget_fit": sc.budget_fit("pricing_min", "promotion_budget"),
    }
    wide = pairs.withColumns({f"f_{k}": v for k, v in parts.items()})
    named = {k: F.col(f"f_{k}") for k in parts}
    return (wide.withColumn("fit_score", sc.weighted_score([(named[k], w) for k, w, _ in rules.FIT_COMPONENTS]))
            .withColumn("fit_reasons", sc.fit_reasons(named)).drop(*[f"f_{k}" for k in parts]))


def fit_pairs(campaigns: DataFrame, services: DataFrame, dismissed: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Services a campaign may rank: its tenant's, not blocked, not dismissed, and on
    request only those without a score yet."""
    open_services = services.filter(F.coalesce(F.col("screening_status") != "BLOCKED", F.lit(True)))
    pairs = campaigns.join(open_services, "tenant_id").join(
        dismissed.select("campaign_id", "service_id"), ["campaign_id", "service_id"], "left_anti")
    return pairs if scored is None else pairs.join(scored.select("campaign_id", "service_id").distinct(),
                                                   ["campaign_id", "service_id"], "left_anti")


def service_filter(view: str = "all", service_type=None, genre=None, territory=None, channel=None,
                   price_max=None) -> Column:
    """Conjunction of the chosen filters; an unknown price fails a price ceiling."""
    cond = F.lit(True)
    wanted = {"screened": "SCREENED", "caution": "CAUTION", "unknown": "UNKNOWN", "blocked": "BLOCKED",
              "best-fit": "SCREENED"}.get(view)
    if wanted:
        cond &= F.col("screening_status") == wanted
    if service_type:
        cond &= F.array_contains("service_types", service_type)
    if genre:
        cond &= F.exists("supported_genres", lambda g: F.lower(g) == genre.lower())
    if territory:
        cond &= F.exists("supported_territories", lambda t: F.upper(t) == territory.upper())
    if channel:
        cond &= F.exists("service_types", lambda t: tx.channel_of(t) == channel)
    if price_max is not None:
        cond &= F.coalesce(F.col("pricing_min") <= price_max, F.lit(False))
    return cond


def campaign_services(pairs: DataFrame, fits: DataFrame, view: str, as_of, parts: int | None = None, **filters) -> DataFrame:
    """Service list of each campaign: safety group first, then fit, unknown fit last.

    With ``parts``, both sides are dealt to so many by their keys, whatever sizes Spark expects of them.
    """
    if parts:
        pairs, fits = (side.repartition(parts, "campaign_id", "service_id") for side in (pairs, fits))
    newest = newest_per_key(fits, ["campaign_id", "service_id"], ["created_at", "seq"], ["fit_score"])
    rows = (pairs.filter(service_filter(view, **filters)).join(newest, ["campaign_id", "service_id"], "left")
            .withColumn("fit_score", F.when(F.col("screening_status") != "BLOCKED", F.col("fit_score")))
            .withColumn("stale", service_is_stale(as_of))
            .withColumn("pricing_current", pricing_is_current(as_of)))
    group = F.lit(0) if view == "best-fit" else F.coalesce(tx.lookup("screening_status", rules.SCREENING_LIST_ORDER), F.lit(9))
    return rows.withColumn("list_group", group).orderBy(
        "campaign_id", "list_group", F.col("fit_score").desc_nulls_last(), "name")


def service_is_stale(as_of) -> Column:
    return F.when(F.col("next_review_at").isNull(), F.col("last_screened_at").isNull()).otherwise(
        is_past("next_review_at", as_of))


def pricing_is_current(as_of) -> Column:
    return F.coalesce((F.col("pricing_min").isNotNull())
                      & (days_since("pricing_last_verified_at", as_of) <= rescreen_window("screening_status")), F.lit(False))


def next_review(status: str | Column, screened_at) -> Column:
    return plus_days(screened_at, rescreen_window(status))


def evidence_view(packets: DataFrame, keys, order, as_of) -> DataFrame:
    """Every packet, marked superseded when a later read of its page replaced it."""
    newest = packets.groupBy(*keys).agg(F.max_by(
        F.struct(F.col("content_hash").alias("b"), F.col("retrieved_at").alias("r")), order_struct(order)).alias("__new"))
    same = F.col("retrieved_at").eqNullSafe(F.col("__new.r")) & (
        F.col("__new.b").isNull() | F.col("content_hash").eqNullSafe(F.col("__new.b")))
    out = packets.join(newest, list(keys)).withColumn("superseded", ~same).drop("__new")
    return out.withColumn("stale", is_stale("stale_at", as_of)) if "stale_at" in packets.columns else out


def refetch_urls(services: DataFrame, packets: DataFrame) -> DataFrame:
    """Every URL a re-screen has to read again, once each."""
    own = services.select("service_id", F.explode(F.array_compact(F.array(
        "url", "terms_url", "pricing_url", "submission_url", "contact_url"))).alias("url"))
    seen = packets.filter(F.length("source_url") > 0).select("service_id", F.col("source_url").alias("url"))
    return own.filter(F.length("url") > 0).unionByName(seen).distinct()


def plan_totals(items: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Spent, planned and unknown amounts per campaign; no budget means no remainder."""
    amount, paid = F.col("amount"), F.col("paid_at").isNotNull()
    sums = items.groupBy("campaign_id").agg(
        F.sum(F.when(paid & (F.col("status") != "REFUNDED"), amount)).alias("spent"),
        F.sum(F.when(~paid & F.col("status").isin(rules.PLANNED_STATUSES), amount)).alias("planned"),
        F.count_if(amount.isNull()).alias("unknown_amounts"), F.count("*").alias("items"))
    return (campaigns.select("campaign_id", "promotion_budget").join(sums, "campaign_id", "left")
            .fillna({"spent": 0.0, "planned": 0.0, "unknown_amounts": 0, "items": 0})
            .withColumn("remaining", F.col("promotion_budget") - (F.col("planned") + F.col("spent"))))


def suggested_allocation(totals: DataFrame, qualifying: DataFrame) -> DataFrame:
    """Even split of what is left over the categories with a screened, fitted option.

    ``qualifying(campaign_id, service_types)`` holds the screened services that have a
    fit and were not dismissed.  The per-campaign category set is bounded by the
    fixed vocabulary.
    """
    kinds = F.when(F.size("service_types") > 0, F.transform("service_types", lambda t: F.coalesce(
        tx.lookup(t, rules.SERVICE_TYPE_TO_ALLOCATION), F.lit("OTHER")))).otherwise(F.array(F.lit("OTHER")))
    cats = qualifying.select("campaign_id", F.explode(kinds).alias("category")).distinct()
    n = cats.groupBy("campaign_id").agg(F.count("*").alias("categories"))
    left = totals.filter(F.col("remaining") > 0).select("campaign_id", "remaining")
    return (cats.join(n, "campaign_id").join(left, "campaign_id")
            .withColumn("amount", F.bround(F.round("remaining", 2) / F.col("categories"), 2)))


def service_edits(services: DataFrame, log: DataFrame, order=("seq",)) -> DataFrame:
    """Notes, review flags and commercial relations from their edit log."""
    by = order_struct(order)

    def newest(kind: str, col: str) -> Column:
        return F.max_by(col, F.when(F.col("kind") == kind, by))
    edits = log.groupBy("service_id").agg(
        newest("NOTE", "text").alias("note"), newest("RELATION", "relation").alias("relation"),
        newest("RELATION", "text").alias("disclosure"),
        F.max_by("kind", F.when(F.col("kind").isin("REVIEW_RAISED", "REVIEW_RESOLVED"), by)).alias("__review"))
    return (services.join(edits, "service_id", "left")
            .withColumn("note", F.substring("note", 1, 2000))
            .withColumn("relation", F.coalesce("relation", F.lit("NONE")))
            .withColumn("manual_review_required", F.coalesce(F.col("__review") == "REVIEW_RAISED", F.lit(False)))
            .drop("__review"))


def addable(items: DataFrame, services: DataFrame) -> DataFrame:
    """Plan items that may be added: never one of a blocked service."""
    blocked = services.filter(F.col("screening_status") == "BLOCKED").select("service_id")
    return items.join(blocked, "service_id", "left_anti")
