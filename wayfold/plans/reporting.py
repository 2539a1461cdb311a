"""Metrics, funnels, attribution and operational reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import score as sc
from wayfold.functions import text as tx
from wayfold.functions.when import days_since, moment
from wayfold.operators.latest import first_n_per_key, newest_per_key, order_struct


def stage_counts(targets: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Targets per campaign and stage; empty stages stay, as zero."""
    n = {label: F.count_if(F.col("status").isin(statuses)) for label, statuses in rules.PIPELINE_STAGES}
    sums = targets.groupBy("campaign_id").agg(*[c.alias(f"s{i}") for i, c in enumerate(n.values())])
    wide = campaigns.select("campaign_id").join(sums, "campaign_id", "left")
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(label).alias("stage"),
                              F.coalesce(f"s{i}", F.lit(0)).alias("targets")) for i, label in enumerate(n)])
    return wide.select("campaign_id", F.explode(rows).alias("r")).select("campaign_id", "r.*")


def _status(*names: str) -> Column:
    return F.count_if(F.col("status").isin(list(names)))


def campaign_metrics(campaigns: DataFrame, targets: DataFrame, scores: DataFrame, verified: DataFrame,
                     submissions: DataFrame, responses: DataFrame, placements: DataFrame) -> DataFrame:
    """Fifteen figures per campaign, each an aggregate of stored rows.

    ``verified`` holds the target ids with a verified, sendable contact method.
    """
    newest = newest_per_key(scores, ["target_id"], ["created_at", "seq"], ["score"])
    counted = (targets.join(newest, "target_id", "left")
               .join(verified.select("target_id", F.lit(True).alias("__v")).distinct(), "target_id", "left"))
    base = counted.groupBy("campaign_id").agg(
        F.count("*").alias("discovered"), F.count_if(F.col("score") >= 70).alias("high_fit"),
        F.count("__v").alias("verified"),
        _status("READY", "DRAFTED", "NEEDS_APPROVAL", "APPROVED", "QUEUED").alias("ready"),
        _status("QUALIFIED").alias("qualified"), _status("DUPLICATE").alias("duplicates"),
        _status("DISQUALIFIED").alias("disqualified"), _status("BLOCKED").alias("blocked"),
        _status("OPTED_OUT").alias("opted_out"), _status("BOUNCED").alias("bounced"),
        _status("DRAFTED").alias("drafted"))
    owner = targets.select("target_id", "campaign_id")

    def per_campaign(df: DataFrame, out: str) -> DataFrame:
        per_target = df.groupBy("target_id").agg(F.count("*").alias("n"))
        return per_target.join(owner, "target_id").groupBy("campaign_id").agg(F.sum("n").alias(out))
    parts = [base, per_campaign(submissions.filter(F.col("sent_at").isNotNull()), "submitted"),
             per_campaign(responses, "responses"),
             placements.filter(F.col("removed_date").isNull()).groupBy("campaign_id").agg(F.count("*").alias("placed"))]
    wide = reduce(lambda a, b: a.join(b, "campaign_id", "left"), parts, campaigns.select("campaign_id"))
    names = [c for c in wide.columns if c != "campaign_id"]
    return (wide.fillna(0, names)
            .withColumn("response_rate", sc.percent("responses", "submitted"))
            .withColumn("placement_rate", sc.percent("placed", "submitted")))


def campaign_stage() -> Column:
    """First rule that holds over the metrics row."""
    return (F.when((F.col("responses") > 0) | (F.col("placed") > 0), "Results")
            .when(F.col("submitted") > 0, "Outreach").when(F.col("drafted") > 0, "Review")
            .when(F.col("discovered") > 0, "Opportunities").when(F.coalesce("searches_used", F.lit(0)) > 0, "Discover")
            .otherwise("Setup"))


def campaign_health(metrics: DataFrame, progress: DataFrame) -> DataFrame:
    """0-100 index of four clamped ratios."""
    m = metrics.join(progress.select("campaign_id", "failed", "total"), "campaign_id", "left")
    d = F.col("discovered")

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    failed = ratio(F.coalesce("failed", F.lit(0)), F.coalesce("total", F.lit(0)))
    factors = {"qualified_yield": (F.least(F.lit(1.0), ratio(F.col("qualified") + F.col("ready"), d)), 0.3),
               "duplicate_control": (F.greatest(F.lit(0.0), F.lit(1.0) - ratio(F.col("duplicates"), d) * 2), 0.2),
               "contact_verification": (F.least(F.lit(1.0), ratio(F.col("verified"), d) * 2), 0.3),
               "job_reliability": (F.greatest(F.lit(0.0), F.lit(1.0) - failed), 0.2)}
    total = reduce(lambda a, b: a + b, [v * F.lit(w) for v, w in factors.values()])
    return m.select("campaign_id", F.bround(total * 100).cast("bigint").alias("health"),
                    *[F.bround(v * 100).cast("bigint").alias(k) for k, (v, _) in factors.items()])


def job_progress(log: DataFrame, keys, order, newest: int = 200) -> DataFrame:
    """Progress over each campaign's newest jobs."""
    rows = first_n_per_key(log, keys, order, newest, "__rank")
    done = F.count_if(F.col("status").isin("SUCCEEDED", "CANCELLED"))
    total = F.count("*")
    return rows.groupBy(*keys).agg(
        total.alias("total"), done.alias("done"),
        F.count_if(F.col("status").isin("FAILED", "DEAD_LETTER")).alias("failed"),
        F.count_if(F.col("status") == "RUNNING").alias("running"),
        F.count_if(F.col("status") == "PENDING").alias("pending"),
        F.bround(done / total * 100).cast("bigint").alias("pct"))


def stuck_jobs(log: DataFrame, as_of, seconds: int = 300) -> DataFrame:
    return log.filter((F.col("status") == "RUNNING")
                      & (F.col("started_at") < moment(as_of) - F.expr(f"INTERVAL {seconds} SECONDS")))


def placement_value(placements: DataFrame, outcomes: DataFrame, as_of, order=("captured_at", "seq")) -> DataFrame:
    """Value of a placement over the metrics really measured; a measured zero is left
    out of the mean, as is anything unknown."""
    last = outcomes.groupBy("placement_id", "metric").agg(F.max_by("value", order_struct(order)).alias("value"))
    wide = last.groupBy("placement_id").pivot("metric", [m for m, _ in rules.PLACEMENT_WEIGHTS]).agg(F.first("value"))
    end = F.coalesce("removed_date", F.to_date(moment(as_of)))
    rows = placements.join(wide, "placement_id", "left").withColumn(
        "duration_days", F.greatest(F.lit(0), F.datediff(end, F.col("added_date"))).cast("double"))
    parts = [(F.when(F.col(m) != 0, F.col(m)), w) for m, w in
             [*rules.PLACEMENT_WEIGHTS, ("duration_days", rules.PLACEMENT_DURATION_WEIGHT)]]
    capped = [(F.when(v.isNotNull(), F.least(F.lit(1.0), v / 1000)), w) for v, w in parts]
    return (rows.withColumn("score", sc.weighted_score(capped))
            .withColumn("state", F.when(F.col("score").isNull(), "UNMEASURED").otherwise("MEASURED"))
            .withColumn("cost_per_point", F.when((F.col("score") > 0) & (F.col("cost") > 0),
                                                 F.bround(F.col("cost") / F.col("score"), 2))))


def attribution(campaigns: DataFrame, snapshots: DataFrame, order=("captured_at", "seq"),
                metrics=tuple(rules.ATTRIBUTION_METRICS)) -> DataFrame:
    """First baseline against last outcome per campaign and metric."""
    by = order_struct(order)
    ends = snapshots.filter(F.col("metric").isin(list(metrics))).groupBy("campaign_id", "metric").agg(
        F.min_by("value", F.when(F.col("kind") == "BASELINE", by)).alias("baseline"),
        F.max_by("value", F.when(F.col("kind") == "OUTCOME", by)).alias("outcome"))
    grid = campaigns.select("campaign_id", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    rows = grid.join(ends, ["campaign_id", "metric"], "left")
    state = F.when(F.col("baseline").isNull(), "NO_BASELINE").when(F.col("outcome").isNull(), "NO_OUTCOME").otherwise("MEASURED")
    return (rows.withColumn("state", state)
            .withColumn("outcome", F.when(F.col("state") == "MEASURED", F.col("outcome")))
            .withColumn("delta", F.col("outcome") - F.col("baseline")))


def baseline_snapshots(campaigns: DataFrame, recordings: DataFrame, as_of) -> DataFrame:
    """Baseline rows for figures that exist; an absent one is skipped, never zero."""
    return (campaigns.join(recordings.select("recording_id", "streams"), "recording_id").filter(F.col("streams").isNotNull())
            .select("campaign_id", "recording_id", F.lit("BASELINE").alias("kind"), F.lit("streams").alias("metric"),
                    F.col("streams").cast("double").alias("value"), moment(as_of).alias("captured_at")))


def provider_rows(log: DataFrame, keys) -> DataFrame:
    """Calls, units and outcomes of provider requests."""
    return log.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum("cost_units").alias("units"),
        F.count_if(F.col("outcome") == "OK").alias("ok"),
        F.count_if(F.col("outcome") == "RATE_LIMITED").alias("rate_limited"),
        F.count_if(F.col("outcome") == "ERROR").alias("errors"))


def request_units(provider: str | Column, operation: str | Column) -> Column:
    """Quota units of an operation; one where nothing is listed."""
    key = F.concat_ws("|", tx.col_of(provider), tx.col_of(operation))
    return F.coalesce(tx.lookup(key, {"|".join(k): v for k, v in rules.QUOTA_UNIT_COST.items()}), F.lit(1))


def quota_state(log: DataFrame, limits: DataFrame, keys=("tenant_id", "provider")) -> DataFrame:
    """Units used since the window began against the limit; warn from 80 percent.

    ``limits`` has the keys, quota_limit and window_start; fixture runs cost nothing.
    """
    keys = list(keys)
    used = (log.join(limits.select(*keys, "window_start"), keys)
            .filter((F.col("outcome") != "FIXTURE") & (F.col("created_at") >= F.col("window_start")))
            .groupBy(*keys).agg(F.sum("cost_units").alias("quota_used")))
    rows = limits.join(used, keys, "left").withColumn("quota_used", F.coalesce("quota_used", F.lit(0)))
    return (rows.withColumn("quota_pct", sc.percent("quota_used", "quota_limit"))
            .withColumn("warn", F.coalesce(F.col("quota_used") / F.col("quota_limit") >= 0.8, F.lit(False))))


def connection_states(policies: DataFrame, quota: DataFrame) -> DataFrame:
    """What each provider connection shows; missing credentials never read as connected."""
    p = F.col("policy_status")
    rows = policies.join(quota, "provider", "left")
    connected = F.coalesce("needs_no_credentials", F.lit(False)) | F.coalesce("credentials_present", F.lit(False))
    spent = F.coalesce(F.col("quota_used") >= F.col("quota_limit"), F.lit(False))
    return rows.withColumn(
        "state", F.when(F.coalesce("kill_switch", F.lit(False)), "DISABLED")
        .when(p.isin("BLOCKED", "DISABLED", "MANUAL_ONLY", "APPROVAL_REQUIRED"), p)
        .when(connected & spent, "QUOTA_LIMITED").when(connected, "CONNECTED").otherwise("NOT_CONNECTED"))


def stop_reason(counts: DataFrame) -> DataFrame:
    """Why discovery of a campaign should stop, null to go on."""
    total, dup = F.col("total"), F.col("duplicates")
    good = F.col("qualified")
    budget = F.coalesce(F.col("search_budget"), F.lit(rules.DEFAULT_SEARCH_BUDGET))
    reason = (F.when(F.coalesce("campaign_status", F.lit("")) == "CANCELLED", F.lit("Campaign cancelled by user"))
              .when(F.coalesce("searches_used", F.lit(0)) >= budget, F.format_string(
                  "Search budget reached (%d/%d)", F.coalesce("searches_used", F.lit(0)), budget))
              .when((total >= 20) & (dup / total > 0.6), F.format_string(
                  "Duplicate rate %d%% — diminishing returns", F.bround(dup / total * 100).cast("int")))
              .when((total >= 20) & (good / total < 0.05), F.format_string(
                  "Qualified yield %d%% — diminishing returns", F.bround(good / total * 100).cast("int"))))
    return counts.withColumn("stop_reason", reason)


def task_groups(tasks: DataFrame, keys=("tenant_id",)) -> DataFrame:
    """Open tasks by why they need a human, largest group first."""
    label = F.coalesce(tx.lookup("reason_key", rules.TASK_GROUPS), F.lit("Other"))
    return (tasks.filter(F.col("status").isin("OPEN", "IN_PROGRESS")).withColumn("group", label)
            .groupBy(*keys, "group").agg(F.count("*").alias("tasks"), F.array_sort(F.collect_set("reason_key")).alias("reasons")))


def task_queue(tasks: DataFrame, as_of) -> DataFrame:
    """Open tasks, nearest deadline first, those without one at the end."""
    return (tasks.filter(F.col("status").isin("OPEN", "IN_PROGRESS", "SNOOZED"))
            .withColumn("deadline_days", F.bround(-days_since("deadline", as_of)).cast("bigint"))
            .withColumn("snoozed", F.coalesce(F.col("snooze_until") > moment(as_of), F.lit(False)))
            .orderBy(F.col("deadline").asc_nulls_last(), "created_at", "task_id"))


def profile_completeness(fields: DataFrame) -> DataFrame:
    """Known share and missing required fields per profile, over the declared fields."""
    need = F.when(F.col("required") & ~F.col("known"), F.struct("position", "field"))
    total, known = F.count("*"), F.count_if("known")
    return fields.groupBy("profile_id").agg(
        known.alias("known"), total.alias("total"), F.bround(known / total * 100).cast("bigint").alias("score"),
        F.transform(F.array_sort(F.collect_set(need)), lambda s: s["field"]).alias("missing_required")).withColumn(
        "ready", F.size("missing_required") == 0)


def setup_steps(tenants: DataFrame, **sources: DataFrame) -> DataFrame:
    """One row per tenant and step, done when the tenant has any row in its source."""
    out = None
    for step, source in sources.items():
        have = source.groupBy("tenant_id").agg(F.count("*").alias("rows"))
        one = (tenants.select("tenant_id").join(have, "tenant_id", "left")
               .select("tenant_id", F.lit(step).alias("step"), F.coalesce("rows", F.lit(0)).alias("rows"))
               .withColumn("state", F.when(F.col("rows") > 0, "DONE").otherwise("TODO")))
        out = one if out is None else out.unionByName(one)
    return out


def next_actions(counts: DataFrame, limit: int = 5) -> DataFrame:
    """Ranked work list per tenant: only real counts, at most ``limit`` entries.

    ``counts`` has tenant_id and one count column per action, in rank order.
    """
    names = [c for c in counts.columns if c != "tenant_id"]
    rows = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("action"),
                              F.col(n).cast("bigint").alias("items")) for i, n in enumerate(names)])
    kept = F.slice(F.filter(rows, lambda r: r["items"] > 0), 1, limit)
    return counts.select("tenant_id", F.explode(kept).alias("r")).select("tenant_id", "r.*")


def relationship_list(relationships: DataFrame, outlets: DataFrame, targets: DataFrame, submissions: DataFrame,
                      responses: DataFrame, notes: DataFrame, as_of) -> DataFrame:
    """Relationships of every tenant with their counts; counts may be zero."""
    place = targets.select("target_id", "outlet_id")

    def per_outlet(df: DataFrame, *aggs: Column) -> DataFrame:
        return df.join(place, "target_id").groupBy("tenant_id", "outlet_id").agg(*aggs)
    sent = per_outlet(submissions, F.count("*").alias("submissions"))
    back = per_outlet(responses, F.count("*").alias("responses"),
                      F.count_if(F.col("kind") == "ACCEPT").alias("accepted_responses"))
    out = targets.groupBy("tenant_id", "outlet_id").agg(F.count_if(F.col("status") == "OPTED_OUT").alias("opted_out"))
    noted = notes.groupBy("tenant_id", "relationship_id").agg(F.count("*").alias("note_count"))
    days = F.greatest(F.lit(1), F.bround(-days_since("next_eligible_at", as_of))).cast("bigint")
    keys = ["tenant_id", "outlet_id"]
    return (relationships.join(outlets.select("outlet_id", "outlet_name"), "outlet_id", "left")
            .join(sent, keys, "left").join(back, keys, "left").join(out, keys, "left")
            .join(noted, ["tenant_id", "relationship_id"], "left")
            .fillna(0, ["submissions", "responses", "accepted_responses", "opted_out", "note_count"])
            .withColumn("eligible_in_days", F.when(F.col("next_eligible_at") > moment(as_of), days)))


def target_list(targets: DataFrame, outlets: DataFrame, scores: DataFrame, risks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Targets with their outlet and the newest score, risk and decision; one shuffle
    per log instead of a lookup per row."""
    s = newest_per_key(scores, ["target_id"], ["created_at", "seq"], ["score"])
    r = newest_per_key(risks, ["target_id"], ["created_at", "seq"], ["risk_score", "risk_band"])
    d = newest_per_key(decisions, ["target_id"], ["created_at", "seq"], ["decision"])
    return (targets.join(outlets.select("outlet_id", "outlet_name"), "outlet_id", "left")
            .join(s, "target_id", "left").join(r, "target_id", "left").join(d, "target_id", "left"))


def view_filter(view: str) -> Column:
    wanted = rules.OPPORTUNITY_VIEWS.get(view)
    return F.lit(True) if view == "all" else F.col("status").isin(wanted or rules.OPPORTUNITY_VIEWS["actionable"])


def response_times(responses: DataFrame, submissions: DataFrame | None, keys) -> DataFrame:
    """Count and mean days from a submission to its response; without ``submissions`` the responses carry ``sent_at``."""
    pairs = responses if submissions is None else responses.join(
        submissions.select("submission_id", "sent_at"), "submission_id")
    pairs = pairs.filter(F.col("sent_at").isNotNull())
    days = (F.unix_micros("received_at") - F.unix_micros("sent_at")) / 86_400e6
    return pairs.groupBy(*keys).agg(F.count("*").alias("count"), F.bround(F.avg(days), 1).alias("average_days"))


def budget_use(log: DataFrame, keys) -> DataFrame:
    """Budget counters from the work log instead of a counter kept in a row."""
    return log.groupBy(*keys).agg(F.sum("searches").alias("searches_used"), F.sum("pages").alias("pages_fetched"),
                                  F.sum("emails").alias("emails_sent"), F.sum("spend").alias("spend"))


def sweep_state(log: DataFrame, keys=("tenant_id",)) -> DataFrame:
    """Sweep start, end and spend from the run log; it ends when nothing is open."""
    still = F.count_if(F.col("status").isin("PENDING", "RUNNING"))
    return log.groupBy(*keys).agg(
        F.min("started_at").alias("started_at"), F.when(still == 0, F.max("finished_at")).alias("finished_at"),
        F.count_if(F.col("kind") == "SEARCH").alias("searches_used"), still.alias("open_jobs"))


def campaign_gate(recordings: DataFrame, attested: DataFrame, completeness: DataFrame) -> DataFrame:
    """May a campaign start for each recording?  Needs an attestation and a ready profile."""
    rows = (recordings.select("recording_id", "profile_id")
            .join(attested.select("recording_id", F.lit(True).alias("__a")).distinct(), "recording_id", "left")
            .join(completeness.select("profile_id", "ready", "missing_required"), "profile_id", "left"))
    missing = F.concat(F.when(F.col("__a").isNull(), F.array(F.lit("rights_attestation"))).otherwise(F.array().cast("array<string>")),
                       F.coalesce("missing_required", F.array(F.lit("profile"))))
    return rows.select("recording_id", missing.alias("missing"), (F.size(missing) == 0).alias("allowed"))


def newest_edits(log: DataFrame, keys, fields, order=("seq",)) -> DataFrame:
    """Current value of each editable field: the newest log row that sets it."""
    by = order_struct(order)
    return log.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), by)).alias(f) for f in fields])
