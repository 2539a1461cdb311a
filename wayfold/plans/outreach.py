"""Drafts, approvals, the send gate, tasks and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import keys as ky
from wayfold.functions import text as tx
from wayfold.functions.when import days_since, moment
from wayfold.operators.latest import newest_per_key, order_struct

GREETING = {"de": "Hallo %s,", "en": "Hello %s,"}
CLOSING = {"de": "Vielen Dank für Ihre Zeit,", "en": "Best,"}
REQUEST = {
    "de": "Wäre der Track etwas für Sie? Ich freue mich über jede Rückmeldung.",
    "en": "If it's a fit for what you're programming, I'd be glad for you to consider it. "
          "Either way, thank you for reading.",
}


def guard_sources(groups: DataFrame, policies: DataFrame, keys, flag: str) -> DataFrame:
    """May data of these sources be used together?  One forbidden source refuses the
    whole group, and a source without a policy is forbidden.

    ``groups`` has the key columns and ``source``; ``policies(source, <flags>)``.
    The refused names are bounded by the policy vocabulary plus one mark for unknown.
    """
    rows = groups.select(*keys, "source").distinct().join(policies.select("source", F.col(flag).alias("__ok")), "source", "left")
    name = F.when(F.col("__ok").isNull(), F.lit("unregistered")).when(~F.col("__ok"), F.col("source"))
    return rows.groupBy(*keys).agg(F.bool_and(F.coalesce("__ok", F.lit(False))).alias("allowed"),
                                   F.array_sort(F.collect_set(name)).alias("blocked_sources"))


def usage_policies(providers: DataFrame) -> DataFrame:
    """Source-use policy per source: provider records plus the first-party sources."""
    own = providers.sparkSession.createDataFrame(
        [(s, True, True, True, True, False, None) for s in rules.USER_OWNED_SOURCES],
        "source string, user_owned boolean, may_store_excerpt boolean, may_embed boolean, may_send_to_llm boolean, "
        "may_train boolean, retention_days int")
    return providers.select(
        F.col("provider").alias("source"), F.lit(False).alias("user_owned"), F.lit(True).alias("may_store_excerpt"),
        "may_embed", "may_send_to_llm", "may_train", "retention_days").unionByName(own)


def drafts(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Mail-merge: every sentence rests on a cited fact; refused or leaking drafts are
    marked and carry no body.

    ``rows`` joins target, outlet, recording, profile, newest score reasons, chosen
    contact method and sender identity.
    """
    empty = F.array().cast("array<string>")
    name = F.coalesce("outlet_name", F.lit("there"))
    micro = F.transform(F.coalesce("microgenres", empty), F.lower)
    shared = F.try_element_at(F.filter("outlet_genres", lambda g: F.array_contains(micro, F.lower(g))), F.lit(1))
    candidate = F.coalesce(F.lower(F.try_element_at("outlet_languages", F.lit(1))), F.when(F.upper("territory") == "DE", F.lit("de")))
    language = F.when(candidate == "de", "de").otherwise("en")
    flagged = F.coalesce(candidate.isNotNull() & ~candidate.isin("de", "en"), F.lit(False))

    def fact(claim: Column | str, basis: str | Column, source: str) -> Column:
        return F.struct((claim if isinstance(claim, Column) else F.lit(claim)).alias("claim"),
                        (basis if isinstance(basis, Column) else F.lit(basis)).alias("basis"), F.lit(source).alias("source"))
    why = (F.when(shared.isNotNull(), F.concat(F.lit("I'm writing because "), name, F.lit(" covers "), shared,
                                               F.lit(", which is exactly where this track sits.")))
           .when(F.col("submissions_open") == "OPEN", F.concat(
               F.lit("I saw that "), name, F.lit(" is currently open to music submissions, so I wanted to send one track "
                                                 "for your consideration.")))
           .otherwise(F.concat(F.lit("I'm getting in touch about one track that may suit "), name, F.lit("."))))
    why_fact = (F.when(shared.isNotNull(), fact(F.concat(name, F.lit(" covers "), shared),
                                                "Extracted from the outlet's own page and stored as evidence", "open_web_fetch"))
                .when(F.col("submissions_open") == "OPEN", fact("submissions are open",
                      "Submission guidelines published on the outlet's own page", "open_web_fetch"))
                .otherwise(fact("outlet name", "Outlet page title", "open_web_fetch")))
    genre = F.col("primary_genre")
    streams = F.format_number("streams", 0)
    context = F.concat(
        F.lit('The track is "'), F.col("recording_title"), F.lit('" by '), F.col("artist_name"),
        F.when(F.length(genre) > 0, F.concat(F.lit(", a "), genre, F.lit(" record"))).otherwise(F.lit("")), F.lit("."),
        F.when(F.length("release_narrative") > 0, F.concat(F.lit(" "), F.col("release_narrative"), F.lit(".")))
        .when(F.col("streams") > 0, F.concat(F.lit(" It has "), streams, F.lit(
            " streams to date across the platforms we report on."))).otherwise(F.lit("")))
    bits = F.array_compact(F.array(
        F.when(F.size(F.coalesce("comparable_artists", empty)) > 0, F.concat(
            F.lit("it sits close to "), F.array_join(F.slice("comparable_artists", 1, 2), ", "))),
        F.when(F.size(F.coalesce("mood", empty)) > 0, F.concat(
            F.lit("the mood is "), F.array_join(F.slice("mood", 1, 2), ", ")))))
    fit = F.when(F.size(bits) > 0, F.concat(F.lit("For context, "), F.array_join(bits, " and "), F.lit(".")))
    footer = F.concat_ws("\n", F.concat(F.col("sender_name"), F.lit(" · "), F.col("postal_address")),
                         F.when(F.length("address_source_url") > 0, F.concat(
                             F.lit("We found your submission details at "), F.col("address_source_url"), F.lit("."))),
                         F.lit("If you'd rather not hear from us, reply with 'unsubscribe' and we will not contact you again."))
    body = F.concat_ws("\n\n", F.replace(
        tx.lookup("language", GREETING), F.lit("%s"), name), why, context, fit,
        F.when(F.length("link") > 0, F.concat(F.lit("Listen here: "), F.col("link"))), tx.lookup("language", REQUEST),
        F.concat_ws("\n", tx.lookup("language", CLOSING), "artist_name"), F.concat(F.lit("—\n"), footer))
    positive = F.try_element_at(F.filter("reasons", lambda r: r["sign"] == "+"), F.lit(1))["text"]
    facts = F.array_compact(F.array(
        why_fact,
        F.when(positive.isNotNull(), fact("selection reason", F.concat(F.lit("Score component: "), positive), "own_catalog")),
        F.when(F.length(genre) > 0, fact(F.concat(F.lit("genre is "), genre),
                                         "Track intelligence profile, supplied by the rights holder", "user_input")),
        F.when(F.length("release_narrative") > 0, fact(
            "release narrative", "Supplied by the rights holder in the track profile", "user_input"))
        .when(F.col("streams") > 0, fact(F.concat(streams, F.lit(" streams")),
                                         "Catalog figures reported by the artist", "own_catalog")),
        fact("track title and artist", "Catalog record", "own_catalog"),
        F.when(F.size(bits) > 0, fact("comparable artists and mood",
                                      "Track intelligence profile, supplied by the rights holder", "user_input")),
        F.when(F.length("link") > 0, fact("listening link", "First-party asset configured by the campaign owner", "own_catalog")),
        fact("where we found your submission details", F.coalesce("address_source_url", F.lit("Recorded evidence packet")),
             "open_web_fetch")))
    made = (rows.withColumn("language", language).withColumn("translation_flagged", flagged)
            .withColumn("subject", F.concat(F.lit("Submission — "), F.col("artist_name"), F.lit(' — "'), F.col("recording_title"),
                                            F.lit('" ('), F.coalesce(F.nullif(genre, F.lit("")), F.lit("new track")), F.lit(")")))
            .withColumn("body", body).withColumn("facts", facts))
    verdict = guard_sources(made.select("target_id", F.explode("facts").alias("f")).select(
        "target_id", F.col("f.source").alias("source")), policies, ["target_id"], "may_send_to_llm")
    links = F.when(F.length("link") > 0, F.array("link")).otherwise(empty)
    refused = (F.when(F.coalesce(F.length("postal_address"), F.lit(0)) == 0, "NO_POSTAL_ADDRESS")
               .when(~F.coalesce("allowed", F.lit(False)), "SOURCE_FORBIDDEN")
               .when(F.size(tx.secret_labels("body")) > 0, "CONTAINS_SECRET"))
    return (made.join(verdict, "target_id", "left").withColumn("refused", refused)
            .withColumn("payload_hash", F.when(F.col("refused").isNull(), ky.payload_hash(
                F.col("recipient_hash"), F.col("subject"), F.col("body"), links, empty, F.lit(0.0), F.col("from_email"))))
            .withColumn("body", F.when(F.col("refused").isNull(), F.col("body"))))


def approval_validity(targets: DataFrame, approvals: DataFrame, live_drafts: DataFrame) -> DataFrame:
    """Is there an approval that still matches the draft?  Every target gets a reason."""
    by = order_struct(["approved_at", "seq"])
    live = F.col("invalidated_at").isNull()
    last = approvals.groupBy("target_id").agg(
        F.max_by(F.struct("draft_id", F.col("payload_hash").alias("approved_hash"), "cost"), F.when(live, by)).alias("a"),
        F.max_by(F.struct("invalidation_reason"), F.when(~live, F.struct("invalidated_at", "seq"))).alias("r"))
    joined = (targets.join(last, "target_id", "left")
              .withColumn("draft_id", F.col("a.draft_id"))
              .join(live_drafts.select("draft_id", F.col("payload_hash").alias("draft_hash")), "draft_id", "left"))
    reason = (F.when(F.col("a").isNull() & F.col("r").isNotNull(), F.coalesce(
        "r.invalidation_reason", F.lit("Approval was invalidated because the draft changed after approval")))
        .when(F.col("a").isNull(), "No approval on record")
        .when(F.col("draft_hash").isNull(), "Approved draft no longer exists")
        .when(F.col("draft_hash") != F.col("a.approved_hash"),
              "Approved payload no longer matches the draft — a material field changed after approval"))
    return (joined.withColumn("approval_reason", reason).withColumn("approval_valid", F.col("approval_reason").isNull())
            .withColumn("approved_cost", F.col("a.cost")).drop("a", "r"))


def sent_counts(submissions: DataFrame, keys, as_of) -> DataFrame:
    """Email sends in the 24 hours up to ``as_of``, ends included."""
    since = moment(as_of) - F.expr("INTERVAL 1 DAY")
    return submissions.filter((F.col("method") == "EMAIL") & (F.col("sent_at") >= since)).groupBy(*keys).agg(
        F.count("*").alias("sent_today"))


def bounce_rates(submissions: DataFrame) -> DataFrame:
    """Bounced over sent per tenant; nothing sent means 0.0."""
    sent, bad = F.count("sent_at"), F.count_if(F.col("status") == "BOUNCED")
    return submissions.groupBy("tenant_id").agg(F.when(sent > 0, bad / sent).otherwise(F.lit(0.0)).alias("bounce_rate"))


def warmup_caps(submissions: DataFrame, as_of) -> DataFrame:
    """Daily cap per tenant from whole days since its first send."""
    first = submissions.groupBy("tenant_id").agg(F.min("sent_at").alias("first_sent_at"))
    day = F.coalesce(F.floor(days_since("first_sent_at", as_of)), F.lit(0))
    steps = F.array(*[F.lit(n) for n in rules.WARMUP_SCHEDULE])
    place = F.greatest(F.lit(0), F.least(day, F.lit(len(rules.WARMUP_SCHEDULE) - 1))).cast("int")
    return first.withColumn("warmup_cap", F.element_at(steps, place + 1))


def cooldowns(submissions: DataFrame, targets: DataFrame, as_of) -> DataFrame:
    """Days left before a recipient may be written to again, null when free."""
    last = (submissions.filter(F.col("sent_at").isNotNull()).join(targets.select("target_id", "contact_id"), "target_id")
            .groupBy("contact_id").agg(F.max("sent_at").alias("last_sent_at")))
    days = days_since("last_sent_at", as_of)
    return last.withColumn("cooldown_days", F.when(days < rules.RECIPIENT_COOLDOWN_DAYS,
                                                   F.bround(rules.RECIPIENT_COOLDOWN_DAYS - days).cast("bigint")))


def send_gate(rows: DataFrame) -> DataFrame:
    """Every reason a message is held; none means it may go.

    ``rows`` joins the approval check, campaign, sender readiness, send counts, warm-up
    cap, bounce rate, sendability, target status and cooldown of each target.
    """
    def held(when: Column, text: str | Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), text if isinstance(text, Column) else F.lit(text))
    n, t = F.coalesce("campaign_sent", F.lit(0)), F.coalesce("tenant_sent", F.lit(0))
    own = F.array_compact(F.array(
        held(~F.col("approval_valid"), F.col("approval_reason")),
        held(F.col("send_stop"), "Emergency send stop is engaged"),
        held(F.col("mode") == "SCOUT", "Scout mode never sends"),
        held(~F.col("sender_ready"), "Sender health has not passed"),
        held(n >= F.col("daily_send_limit"), F.format_string("Campaign daily send limit reached (%d)", n)),
        held(t >= F.col("warmup_cap"), F.format_string("Warm-up cap reached for today (%d/%d)", t, F.col("warmup_cap"))),
        held(F.col("bounce_rate") > rules.BOUNCE_RATE_PAUSE, F.format_string(
            "Bounce rate %.1f%% exceeds the pause threshold", F.col("bounce_rate") * 100)),
        held(~F.coalesce("has_method", F.lit(False)), "No contact method on this target"),
        held(F.col("recipient_hash") != F.col("value_hash"), "Recipient changed after approval")))
    tail = F.array_compact(F.array(
        held(F.col("target_status").isin(rules.TERMINAL_NO_CONTACT),
             F.format_string("Target status %s forbids further contact", "target_status")),
        held(F.col("cooldown_days").isNotNull(), F.format_string(
            "Recipient is in cooldown for another %d day(s)", "cooldown_days"))))
    return (rows.withColumn("held_because", F.concat(own, F.coalesce("blockers", F.array().cast("array<string>")), tail))
            .withColumn("may_send", F.size("held_because") == 0))


def approval_queue(targets: DataFrame, outlets: DataFrame, live_drafts: DataFrame, scores: DataFrame, approvals: DataFrame) -> DataFrame:
    """Targets with a draft that wait for a human, best score first."""
    newest = newest_per_key(scores, ["target_id"], ["created_at", "seq"], ["score"])
    active = approvals.filter(F.col("invalidated_at").isNull()).groupBy("target_id").agg(F.count("*").alias("approvals"))
    return (targets.filter(F.col("status").isin("DRAFTED", "NEEDS_APPROVAL", "APPROVED", "READY"))
            .join(outlets.select("outlet_id", "outlet_name"), "outlet_id").join(live_drafts, "target_id")
            .join(newest, "target_id", "left").join(active, "target_id", "left").fillna({"approvals": 0})
            .orderBy("campaign_id", F.col("score").desc_nulls_last(), "target_id"))


def task_reason(decision: Column) -> Column:
    """Why a target needs a human; first rung wins."""
    m = F.col("route_method")
    return (F.when(m.isNull(), "NO_API").when(F.coalesce("requires_captcha", F.lit(False)), "CAPTCHA")
            .when(F.coalesce("requires_login", F.lit(False)), "LOGIN").when(m == "WEB_FORM", "NO_API")
            .when(decision == "LEGAL_REVIEW", "LEGAL").when(F.col("cost_model") == "PAID_CONSIDERATION", "PAID")
            .otherwise("JUDGMENT"))


def human_tasks(rows: DataFrame) -> DataFrame:
    """One task per target that cannot be automated, with the reason in words."""
    reason = task_reason(F.col("decision"))
    return (rows.withColumn("reason_key", reason)
            .withColumn("reason", tx.lookup("reason_key", rules.TASK_REASONS))
            .withColumn("title", F.concat(F.lit("Submit to "), F.coalesce("outlet_name", F.lit("outlet"))))
            .withColumn("destination_url", F.coalesce("destination", "url"))
            .withColumn("effort", F.when(F.col("reason_key") == "JUDGMENT", rules.EFFORT["QUICK"]).otherwise(rules.EFFORT["MEDIUM"]))
            .withColumn("fields", F.array_compact(F.array(
                F.when(F.col("route_method").isNotNull(), F.struct(F.lit("Submission method").alias("label"), F.col("route_method").alias("value"))),
                F.when(F.length("instructions") > 0, F.struct(F.lit("Published instructions").alias("label"), F.col("instructions").alias("value"))),
                F.when(F.coalesce(F.col("cost_model"), F.lit("UNKNOWN")) != "UNKNOWN",
                       F.struct(F.lit("Cost model").alias("label"), F.col("cost_model").alias("value")))))))


def copy_ready(values: dict[str, str | Column]) -> Column:
    """Labelled answers; anything unknown says so."""
    return F.array(*[F.struct(F.lit(label).alias("label"), F.coalesce(
        F.nullif(tx.col_of(v).cast("string"), F.lit("")), F.lit("UNKNOWN")).alias("value")) for label, v in values.items()])


def release_tasks(campaigns: DataFrame) -> DataFrame:
    """The fixed provider tasks of each campaign with the one check known from data."""
    table = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(
        ("provider", "title", "reason_key", "destination_url", "effort", "needs"), row)]) for row in rules.RELEASE_TASKS])
    rows = campaigns.select("*", F.explode(table).alias("t")).select(*campaigns.columns, "t.*")
    metadata = (F.length("isrc") > 0) & (F.length("primary_genre") > 0)
    return (rows.withColumn("eligible", F.when(F.col("needs") == "metadata", F.coalesce(metadata, F.lit(False)))
                            .otherwise(F.coalesce("distributed", F.lit(False))))
            .withColumn("reason", tx.lookup("reason_key", rules.TASK_REASONS)).drop("needs"))


def task_effects(events: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual submissions and broken routes that follow from task status events."""
    rows = events.join(tasks.select("task_id", "target_id", "route_id", "provider", "cost"), "task_id") \
        .filter(F.col("target_id").isNotNull())
    sent = rows.filter(F.col("status") == "SUBMITTED").select(
        "target_id", "provider", "cost", F.lit("HUMAN_ACTION").alias("method"), F.col("ts").alias("sent_at"))
    broken = rows.filter((F.col("status") == "BROKEN_ROUTE") & F.col("route_id").isNotNull()).select("route_id", "target_id").distinct()
    return sent, broken


def responses_with_kind(responses: DataFrame) -> DataFrame:
    """Replies that ask to stop become opt-outs; every kind gets its sentiment."""
    kind = F.when((F.col("kind") == "REPLY") & tx.looks_like_opt_out("body"), "OPT_OUT").otherwise(F.col("kind"))
    return (responses.withColumn("kind", kind).withColumn("sentiment", tx.default_sentiment("kind"))
            .withColumn("body_excerpt", F.when(F.length("body") > 0, F.substring("body", 1, 600))))


def follow_ups_due(sends: DataFrame, responses: DataFrame, keys, as_of, days: int = rules.FOLLOW_UP_DAYS) -> DataFrame:
    """Sends older than ``days`` without any response of the same key after them."""
    last = responses.groupBy(*keys).agg(F.max("ts").alias("__last"))
    due = F.col("ts") + F.make_dt_interval(F.lit(days))
    return (sends.join(last, list(keys), "left").withColumn("due_at", due)
            .filter((F.col("due_at") <= moment(as_of)) & (F.col("__last").isNull() | (F.col("__last") < F.col("ts")))).drop("__last"))
