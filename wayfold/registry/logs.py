"""Event log queries: newest rows, ordered scans, folds, as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import text as tx
from wayfold.functions.when import days_since, is_past, moment, plus_days, sweep_is_due
from wayfold.operators import chain, folds, joins, latest, scans
from wayfold.operators.labels import Labels, union_of_labels
from wayfold.plans import outreach, reporting
from wayfold.registry.base import AS_OF, bound, micros, query

DAY = 86_400


@query("W1, R2", """
SELECT entity, event_id, type, epoch_us(ts) AS at_us FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS rn FROM log) WHERE rn = 1
""", "log")
def newest_event_per_entity(spark, root):
    newest = latest.newest_per_key(bound(spark, root, "log"), ["entity"], ["ts", "event_id"], ["event_id", "type", "ts"])
    return newest.select("entity", "event_id", "type", micros("ts").alias("at_us"))


@query("W2", """
SELECT entity, event_id, type FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS rn FROM log) WHERE rn = 1
""", "log")
def oldest_event_per_entity(spark, root):
    return latest.oldest_per_key(bound(spark, root, "log"), ["entity"], ["ts", "event_id"], ["event_id", "type"])


@query("W12, O8", """
SELECT entity, event_id, type, rn AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS rn FROM log) WHERE rn <= 3
""", "log")
def newest_three_events(spark, root):
    rows = bound(spark, root, "log").select("entity", "event_id", "type", "ts")
    out = latest.first_n_per_key(rows, ["entity"], [F.col("ts").desc(), F.col("event_id").desc()], 3)
    return out.select("entity", "event_id", "type", F.col("rank").cast("bigint").alias("rank"))


@query("W4, T3", """
SELECT a.entity, epoch_us(a.ts) AS at_us, a.arrived, CAST(sum(b.arrived) AS BIGINT) AS trailing FROM
  (SELECT entity, ts, count(*) AS arrived FROM log GROUP BY 1, 2) a JOIN
  (SELECT entity, ts, count(*) AS arrived FROM log GROUP BY 1, 2) b
  ON a.entity = b.entity AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 24 HOUR GROUP BY 1, 2, 3
""", "log")
def trailing_day_volume(spark, root):
    out = scans.trailing_count(bound(spark, root, "log").select("entity", "ts"), ["entity"], "ts", DAY, "trailing")
    return out.select("entity", micros("ts").alias("at_us"), "arrived", F.col("trailing").cast("bigint").alias("trailing"))


@query("W4, L3", f"""
SELECT entity, count(*) AS sent_today FROM log
WHERE type = 'purchase' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY GROUP BY 1
""", "log")
def sends_of_last_day(spark, root):
    sends = bound(spark, root, "log").filter("type = 'purchase'").select(
        "entity", F.lit("EMAIL").alias("method"), F.col("ts").alias("sent_at"))
    return outreach.sent_counts(sends, ["entity"], AS_OF)


@query("W11, A4", f"""
SELECT entity AS tenant_id, epoch_us(min(ts)) AS first_us, CASE least(CAST(floor(
    (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(min(ts))) / 86400000000.0) AS BIGINT), 6)
  WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 40 WHEN 3 THEN 80 WHEN 4 THEN 150 WHEN 5 THEN 300 ELSE 500 END AS warmup_cap
FROM log WHERE type = 'purchase' GROUP BY entity
""", "log")
def warmup_cap_per_tenant(spark, root):
    sends = bound(spark, root, "log").filter("type = 'purchase'").select(
        F.col("entity").alias("tenant_id"), F.col("ts").alias("sent_at"))
    out = outreach.warmup_caps(sends, AS_OF)
    return out.select("tenant_id", micros("first_sent_at").alias("first_us"), F.col("warmup_cap").cast("int"))


@query("A2, A3, A5", """
SELECT entity, count(DISTINCT type) AS kinds, sum(CASE WHEN type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors,
  CASE WHEN sum(CASE WHEN type = 'view' THEN 1 ELSE 0 END) > 0 THEN CAST(round_even(
    sum(CASE WHEN type = 'purchase' THEN 1 ELSE 0 END) / sum(CASE WHEN type = 'view' THEN 1 ELSE 0 END) * 100, 0) AS BIGINT) END
    AS purchases_per_view,
  CASE WHEN sum(CASE WHEN type = 'signup' THEN 1 ELSE 0 END) > 0 THEN CAST(round_even(
    sum(CASE WHEN type = 'click' THEN 1 ELSE 0 END) / sum(CASE WHEN type = 'signup' THEN 1 ELSE 0 END) * 100, 0) AS BIGINT)
    ELSE 0 END AS clicks_per_signup
FROM log GROUP BY entity
""", "log")
def ratios_per_entity(spark, root):
    from wayfold.functions.score import percent
    n = lambda kind: F.count_if(F.col("type") == kind)
    sums = bound(spark, root, "log").groupBy("entity").agg(
        F.countDistinct("type").alias("kinds"), n("error").alias("errors"), n("view").alias("v"),
        n("purchase").alias("p"), n("click").alias("c"), n("signup").alias("s"))
    return sums.select("entity", "kinds", "errors", percent("p", "v").alias("purchases_per_view"),
                       percent("c", "s", 0).alias("clicks_per_signup"))


CLAIMS_SQL = "SELECT entity, type, value > 14 AS v, (event_id % 7) / 10.0 AS c FROM log"


@query("A16, R1", f"""
SELECT entity, type AS field, CASE WHEN y IS NOT NULL AND n IS NOT NULL AND y = n THEN NULL
  WHEN y IS NOT NULL AND (n IS NULL OR y > n) THEN TRUE WHEN n IS NOT NULL THEN FALSE END AS state,
  (y IS NOT NULL AND n IS NOT NULL AND y = n) AS conflict
FROM (SELECT entity, type, max(CASE WHEN v THEN c END) AS y, max(CASE WHEN NOT v THEN c END) AS n
      FROM ({CLAIMS_SQL}) GROUP BY 1, 2)
""", "log")
def tri_state_of_claims(spark, root):
    claims = bound(spark, root, "log").select("entity", F.col("type").alias("field"), (F.col("value") > 14).alias("value"),
                                              (F.col("event_id") % 7 / 10.0).alias("confidence"))
    return folds.tri_state_fold(claims, ["entity", "field"])


@query("A17, A19", """
SELECT entity, (SELECT b.type FROM log b WHERE b.entity = a.entity AND b.type <> 'error' ORDER BY ts, event_id LIMIT 1) AS category,
  string_agg(DISTINCT type, ',' ORDER BY type) AS kinds, min(value) AS low, max(value) AS high, epoch_us(max(ts)) AS seen_us
FROM log a GROUP BY entity
""", "log")
def multi_value_fold(spark, root):
    by = F.struct("ts", "event_id")
    rows = bound(spark, root, "log").withColumn("kinds", F.array("type"))
    out = union_of_labels(rows, ["entity"], {"kinds": Labels(RESPONSE_KIND, closed=False)},
                          F.min_by("type", F.when(F.col("type") != "error", by)).alias("category"),
                          F.min("value").alias("low"), F.max("value").alias("high"), F.max("ts").alias("ts"))
    return out.select("entity", "category", F.array_join("kinds", ",").alias("kinds"), "low", "high", micros("ts").alias("seen_us"))


@query("A19", """
SELECT entity, type AS signal, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, type ORDER BY event_id) AS rn FROM log) WHERE rn = 1
""", "log")
def first_signal_per_key(spark, root):
    rows = bound(spark, root, "log").withColumnRenamed("type", "signal")
    return latest.oldest_per_key(rows, ["entity", "signal"], ["event_id"], ["event_id", "value"]).select(
        "entity", "signal", "event_id", "value")


@query("A18, D2", f"""
SELECT entity, type AS fact, bool_and((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0 <= 29) AS all_fresh
FROM log GROUP BY 1, 2
""", "log")
def facts_all_fresh(spark, root):
    return bound(spark, root, "log").groupBy("entity", F.col("type").alias("fact")).agg(
        F.bool_and(days_since("ts", AS_OF) <= 29).alias("all_fresh"))


@query("F5, D1, D3", f"""
SELECT entity, count(*) AS rows, sum(CASE WHEN ts + INTERVAL 14 DAY <= TIMESTAMP '{AS_OF}' THEN 1 ELSE 0 END)::BIGINT AS stale,
  max(ts) + INTERVAL 7 DAY < TIMESTAMP '{AS_OF}' AS sweep_due
FROM log GROUP BY 1
""", "log")
def stale_and_due(spark, root):
    rows = bound(spark, root, "log").withColumn("stale", is_past(plus_days(F.col("ts"), 14), AS_OF))
    out = rows.groupBy("entity").agg(F.count("*").alias("rows"), F.count_if("stale").alias("stale"), F.max("ts").alias("finished"))
    return out.select("entity", "rows", "stale", sweep_is_due("finished", AS_OF, 7).alias("sweep_due"))


@query("J14", """
SELECT p.event_id, p.entity, v.event_id AS view_id, epoch_us(p.ts) - epoch_us(v.ts) AS gap_us
FROM (SELECT * FROM log WHERE type = 'purchase') p
ASOF LEFT JOIN (SELECT entity, ts, max(event_id) AS event_id FROM log WHERE type = 'view' GROUP BY 1, 2) v
  ON p.entity = v.entity AND p.ts >= v.ts
""", "log")
def purchase_after_newest_view(spark, root):
    rows = bound(spark, root, "log").select("entity", "event_id", "ts", "type")
    out = scans.as_of_rows(rows, ["entity"], "ts", "event_id", F.col("type") == "purchase", F.col("type") == "view", ["event_id", "ts"], "seen")
    return out.select("event_id", "entity", F.col("seen.event_id").alias("view_id"),
                      (micros("ts") - F.unix_micros("seen.ts")).alias("gap_us"))


@query("J15", """
SELECT entity, count(*) AS count, round_even(avg(d), 1) AS average_days FROM (
 SELECT p.entity, (epoch_us(p.ts) - epoch_us(v.ts)) / 86400000000.0 AS d
 FROM (SELECT * FROM log WHERE type = 'purchase') p
 ASOF JOIN (SELECT entity, ts, max(event_id) AS event_id FROM log WHERE type = 'view' GROUP BY 1, 2) v
  ON p.entity = v.entity AND p.ts >= v.ts) GROUP BY 1
""", "log")
def response_time_per_entity(spark, root):
    rows = bound(spark, root, "log").select("entity", "event_id", "ts", "type")
    paired = scans.as_of_rows(rows, ["entity"], "ts", "event_id", F.col("type") == "purchase", F.col("type") == "view", ["event_id", "ts"], "seen")
    answers = paired.select("entity", F.col("ts").alias("received_at"), F.col("seen.event_id").alias("submission_id"), F.col("seen.ts").alias("sent_at"))
    return reporting.response_times(answers, None, ["entity"])


@query("T5, J6", f"""
SELECT s.entity, s.event_id, epoch_us(s.ts + INTERVAL 1 DAY) AS due_us FROM log s
LEFT JOIN (SELECT entity, max(ts) AS last FROM log WHERE type = 'purchase' GROUP BY 1) p ON p.entity = s.entity
WHERE s.type = 'signup' AND s.ts + INTERVAL 1 DAY <= TIMESTAMP '{AS_OF}' AND (p.last IS NULL OR p.last < s.ts)
""", "log")
def follow_up_due(spark, root):
    rows = bound(spark, root, "log").select("entity", "event_id", "ts", "type")
    due = outreach.follow_ups_due(rows.filter("type = 'signup'"), rows.filter("type = 'purchase'"), ["entity"], AS_OF, 1)
    return due.select("entity", "event_id", micros("due_at").alias("due_us"))


@query("J16, L6", """
SELECT entity AS campaign_id, 'streams' AS metric, b AS baseline, CASE WHEN b IS NOT NULL THEN o END AS outcome,
 o - b AS delta, CASE WHEN b IS NULL THEN 'NO_BASELINE' WHEN o IS NULL THEN 'NO_OUTCOME' ELSE 'MEASURED' END AS state
FROM (SELECT entity, arg_min(value, struct_pack(a := ts, e := event_id)) FILTER (type = 'view') AS b,
  arg_max(value, struct_pack(a := ts, e := event_id)) FILTER (type = 'purchase') AS o FROM log GROUP BY entity)
UNION ALL SELECT DISTINCT entity, 'total_earned', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 'NO_BASELINE' FROM log
""", "log")
def attribution_per_entity(spark, root):
    rows = bound(spark, root, "log").withColumnRenamed("entity", "campaign_id")
    snaps = rows.filter("type IN ('view', 'purchase')").select(
        "campaign_id", F.lit("streams").alias("metric"), F.when(F.col("type") == "view", "BASELINE").otherwise("OUTCOME").alias("kind"),
        "value", F.col("ts").alias("captured_at"), F.col("event_id").alias("seq"))
    out = reporting.attribution(rows.select("campaign_id").distinct(), snaps)
    return out.select("campaign_id", "metric", "baseline", "outcome", "delta", "state")


@query("W7, R4", """
WITH reads AS (SELECT entity, type, event_id, CAST(ts AS DATE) AS day, sha256(props) AS h FROM log),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, type ORDER BY event_id DESC) AS rn FROM reads) WHERE rn = 1)
SELECT r.entity, r.type, r.event_id FROM reads r JOIN newest n ON r.entity = n.entity AND r.type = n.type
WHERE r.day = n.day AND r.h = n.h
""", "log")
def current_read_batches(spark, root):
    reads = bound(spark, root, "log").select("entity", "type", "event_id", F.to_date("ts").alias("retrieved_at"),
                                             F.sha2(F.encode("props", "utf-8"), 256).alias("content_hash"))
    return folds.current_batch(reads, ["entity", "type"], ["event_id"]).select("entity", "type", "event_id")


@query("W8, X2", """
SELECT entity, type, count(*) AS reads, sum(CASE WHEN p <> h THEN 1 ELSE 0 END)::BIGINT AS changes FROM (
  SELECT entity, type, sha256(props) AS h, lag(sha256(props)) OVER (PARTITION BY entity, type ORDER BY ts, event_id) AS p FROM log)
GROUP BY 1, 2
""", "log")
def content_changes_per_key(spark, root):
    reads = (bound(spark, root, "log").withColumn("digest", F.sha2(F.encode("props", "utf-8"), 256))
             .select("entity", "type", "ts", "event_id", "digest"))
    seen = folds.content_changes(reads, ["entity", "type"], ["ts", "event_id"], "digest")
    return seen.groupBy("entity", "type").agg(F.count("*").alias("reads"), F.count_if("changed").alias("changes"))


SCREEN_LOG = """SELECT entity, ts, event_id, type = 'error' AS human_override, CASE WHEN value < 5 THEN 'SCREENED'
  WHEN value < 15 THEN 'UNKNOWN' WHEN value < 40 THEN 'CAUTION' ELSE 'BLOCKED' END AS status FROM log"""
SEV = "CASE {} WHEN 'SCREENED' THEN 0 WHEN 'UNKNOWN' THEN 1 WHEN 'CAUTION' THEN 2 WHEN 'BLOCKED' THEN 3 END"


def screening_log(spark, root):
    return bound(spark, root, "log").select(
        "entity", "ts", "event_id", (F.col("type") == "error").alias("human_override"), "props",
        F.when(F.col("value") < 5, "SCREENED").when(F.col("value") < 15, "UNKNOWN").when(F.col("value") < 40, "CAUTION")
        .otherwise("BLOCKED").alias("status"))


@query("W10, R3", f"""
WITH s AS ({SCREEN_LOG}), h AS (SELECT *, last_value(CASE WHEN human_override THEN status END IGNORE NULLS) OVER (
  PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS held FROM s)
SELECT entity, event_id, status, held AS override_status, CASE WHEN human_override THEN status
  WHEN coalesce({SEV.format('held')}, -1) > {SEV.format('status')} THEN held ELSE status END AS effective_status FROM h
""", "log")
def screening_history(spark, root):
    out = folds.effective_history(screening_log(spark, root), ["entity"], ["ts", "event_id"])
    return out.select("entity", "event_id", "status", "override_status", "effective_status")


@query("W10, K9", f"""
WITH s AS ({SCREEN_LOG}), n AS (SELECT entity, arg_max(status, struct_pack(a := ts, e := event_id)) AS status,
  arg_max(human_override, struct_pack(a := ts, e := event_id)) AS human,
  arg_max(status, struct_pack(a := ts, e := event_id)) FILTER (human_override) AS held FROM s GROUP BY 1)
SELECT entity, status AS newest_status, held AS override_status, CASE WHEN human THEN status
  WHEN coalesce({SEV.format('held')}, -1) > {SEV.format('status')} THEN held ELSE status END AS effective_status FROM n
""", "log")
def screening_in_force(spark, root):
    return folds.effective_status(screening_log(spark, root), ["entity"], ["ts", "event_id"]).select(
        "entity", "newest_status", "override_status", "effective_status")


RESPONSE_KIND = {"error": "BOUNCE", "signup": "DECLINE", "purchase": "ACCEPT", "click": "REPLY", "view": "AUTO_REPLY"}


@query("T6, L4", """
SELECT entity, CASE type WHEN 'error' THEN 'BOUNCED' WHEN 'signup' THEN 'DECLINED' WHEN 'purchase' THEN 'ACCEPTED'
  ELSE 'RESPONDED' END AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS rn FROM log) WHERE rn = 1
""", "log")
def status_after_responses(spark, root):
    rows = bound(spark, root, "log").withColumn("kind", tx.lookup("type", RESPONSE_KIND))
    return folds.target_status(rows, ["entity"], ["ts", "event_id"])


@query("T4", """
SELECT entity, sum(CASE WHEN type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS accepted_count,
 sum(CASE WHEN type = 'signup' THEN 1 ELSE 0 END)::BIGINT AS declined_count,
 sum(CASE WHEN type = 'click' THEN 1 ELSE 0 END)::BIGINT AS placement_count, epoch_us(max(ts)) AS last_us,
 epoch_us(arg_max(ts + CASE type WHEN 'signup' THEN INTERVAL 365 DAY WHEN 'error' THEN INTERVAL 3650 DAY ELSE INTERVAL 60 DAY END,
   struct_pack(a := ts, e := event_id))) AS next_us FROM log GROUP BY entity
""", "log")
def recontact_dates(spark, root):
    kinds = {"purchase": "ACCEPT", "signup": "DECLINE", "click": "PLACE", "error": "OPT_OUT", "view": "TOUCH"}
    rows = bound(spark, root, "log").withColumn("kind", tx.lookup("type", kinds))
    out = folds.recontact_state(rows, ["entity"], ["ts", "event_id"], "ts")
    return out.select("entity", "accepted_count", "declined_count", "placement_count",
                      micros("last_contact_at").alias("last_us"), micros("next_eligible_at").alias("next_us"))


@query("T2, E9", """
SELECT entity AS tenant_id, CAST(value AS BIGINT) AS dedup_key,
 coalesce(arg_min(CASE type WHEN 'view' THEN 'ARTICLE' WHEN 'click' THEN 'PLAYLIST' WHEN 'purchase' THEN 'PREMIERE' ELSE 'INTERVIEW' END,
   struct_pack(a := ts, e := event_id)) FILTER (type <> 'error'), 'UNKNOWN') AS kind,
 epoch_us(max(ts)) AS seen_us, count(*) AS reads FROM (SELECT * REPLACE (floor(value) AS value) FROM log) GROUP BY 1, 2
""", "log")
def coverage_kind_fold(spark, root):
    from wayfold.plans.entities import fold_coverage
    kinds = {"view": "ARTICLE", "click": "PLAYLIST", "purchase": "PREMIERE", "signup": "INTERVIEW", "error": "UNKNOWN"}
    rows = bound(spark, root, "log").select(
        F.col("entity").alias("tenant_id"), F.floor("value").cast("bigint").alias("dedup_key"), tx.lookup("type", kinds).alias("kind"),
        F.col("props").alias("url"), F.col("ts").alias("retrieved_at"), "event_id")
    return fold_coverage(rows, ["retrieved_at", "event_id"]).select(
        "tenant_id", "dedup_key", "kind", micros("retrieved_at").alias("seen_us"), "reads")


@query("T7, A21", """
SELECT entity AS tenant_id, epoch_us(min(ts)) AS started_us,
 epoch_us(CASE WHEN sum(CASE WHEN type = 'error' AND value > 100 THEN 1 ELSE 0 END) = 0 THEN max(ts) END) AS finished_us,
 sum(CASE WHEN type = 'view' THEN 1 ELSE 0 END)::BIGINT AS searches_used,
 sum(CASE WHEN type = 'error' AND value > 100 THEN 1 ELSE 0 END)::BIGINT AS open_jobs FROM log GROUP BY 1
""", "log")
def sweep_state_per_tenant(spark, root):
    runs = bound(spark, root, "log").select(
        F.col("entity").alias("tenant_id"), F.when(F.col("type") == "view", "SEARCH").otherwise("FETCH").alias("kind"),
        F.when((F.col("type") == "error") & (F.col("value") > 100), "RUNNING").otherwise("SUCCEEDED").alias("status"),
        F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"))
    out = reporting.sweep_state(runs)
    return out.select("tenant_id", micros("started_at").alias("started_us"), micros("finished_at").alias("finished_us"),
                      "searches_used", "open_jobs")


JOB_STATUS = {"view": "SUCCEEDED", "click": "SUCCEEDED", "purchase": "FAILED", "signup": "RUNNING", "error": "PENDING"}
JOB_SQL = "CASE type WHEN 'purchase' THEN 'FAILED' WHEN 'signup' THEN 'RUNNING' WHEN 'error' THEN 'PENDING' ELSE 'SUCCEEDED' END"


@query("A21, W12", f"""
SELECT entity, count(*) AS total, sum(CASE WHEN st = 'SUCCEEDED' THEN 1 ELSE 0 END)::BIGINT AS done,
 sum(CASE WHEN st = 'FAILED' THEN 1 ELSE 0 END)::BIGINT AS failed, sum(CASE WHEN st = 'RUNNING' THEN 1 ELSE 0 END)::BIGINT AS running,
 sum(CASE WHEN st = 'PENDING' THEN 1 ELSE 0 END)::BIGINT AS pending,
 CAST(round_even(sum(CASE WHEN st = 'SUCCEEDED' THEN 1 ELSE 0 END) / count(*) * 100, 0) AS BIGINT) AS pct
FROM (SELECT entity, {JOB_SQL} AS st, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS rn FROM log)
WHERE rn <= 50 GROUP BY 1
""", "log")
def job_progress_per_campaign(spark, root):
    jobs = bound(spark, root, "log").select("entity", "ts", "event_id", tx.lookup("type", JOB_STATUS).alias("status"))
    return reporting.job_progress(jobs, ["entity"], [F.col("ts").desc(), F.col("event_id").desc()], 50)


@query("A21", f"""
SELECT entity, count(*) AS stuck, epoch_us(min(ts)) AS oldest_us FROM log
WHERE type = 'signup' AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 300 SECOND GROUP BY 1
""", "log")
def stuck_jobs_per_campaign(spark, root):
    jobs = bound(spark, root, "log").select("entity", F.col("ts").alias("started_at"), tx.lookup("type", JOB_STATUS).alias("status"))
    return reporting.stuck_jobs(jobs, AS_OF).groupBy("entity").agg(
        F.count("*").alias("stuck"), F.unix_micros(F.min("started_at")).alias("oldest_us"))


@query("A3, L13, A24", """
SELECT entity AS campaign_id, type AS provider, count(*) AS calls, CAST(sum(CASE WHEN type = 'view' THEN 100 ELSE 1 END) AS BIGINT) AS units,
 sum(CASE WHEN value < 20 THEN 1 ELSE 0 END)::BIGINT AS ok, sum(CASE WHEN value >= 20 AND value < 60 THEN 1 ELSE 0 END)::BIGINT AS rate_limited,
 sum(CASE WHEN value >= 60 THEN 1 ELSE 0 END)::BIGINT AS errors FROM log GROUP BY 1, 2
""", "log")
def provider_calls(spark, root):
    return reporting.provider_rows(request_log(spark, root), ["campaign_id", "provider"])


def request_log(spark, root):
    outcome = F.when(F.col("value") < 20, "OK").when(F.col("value") < 60, "RATE_LIMITED").otherwise("ERROR")
    return bound(spark, root, "log").select(
        F.col("entity").alias("campaign_id"), F.col("type").alias("provider"), outcome.alias("outcome"), F.col("ts").alias("created_at"),
        reporting.request_units(F.when(F.col("type") == "view", "youtube"), F.lit("search")).cast("bigint").alias("cost_units"))


@query("A22", """
SELECT provider, 40000 AS quota_limit, used AS quota_used, CAST(round_even(used / 40000 * 100, 0) AS BIGINT) AS quota_pct,
 used / 40000 >= 0.8 AS warn FROM (SELECT type AS provider, CAST(sum(CASE WHEN ts >= TIMESTAMP '2024-01-11'
   THEN CASE WHEN type = 'view' THEN 100 ELSE 1 END ELSE 0 END) AS BIGINT) AS used FROM log GROUP BY 1)
""", "log")
def quota_use(spark, root):
    calls = request_log(spark, root)
    limits = calls.select("provider").distinct().withColumns({
        "quota_limit": F.lit(40000), "window_start": moment("2024-01-11")})
    return reporting.quota_state(calls, limits, ["provider"]).select("provider", "quota_limit", "quota_used", "quota_pct", "warn")


@query("L11, A23", """
WITH u AS (SELECT type AS provider, CAST(sum(CASE WHEN type = 'view' THEN 100 ELSE 1 END) AS BIGINT) AS used FROM log GROUP BY 1),
s AS (SELECT CASE provider WHEN 'error' THEN 'BLOCKED' WHEN 'signup' THEN 'MANUAL_ONLY' WHEN 'click' THEN 'NOT_CONNECTED'
  ELSE CASE WHEN used >= 40000 THEN 'QUOTA_LIMITED' ELSE 'CONNECTED' END END AS state FROM u)
SELECT state, count(*) AS providers FROM s GROUP BY 1
""", "log")
def connection_summary(spark, root):
    calls = request_log(spark, root)
    names = calls.select("provider").distinct()
    limits = names.withColumns({"quota_limit": F.lit(40000), "window_start": moment("2000-01-01")})
    policies = names.withColumns({
        "policy_status": F.when(F.col("provider") == "error", "BLOCKED").when(F.col("provider") == "signup", "MANUAL_ONLY").otherwise("ACTIVE"),
        "needs_no_credentials": F.lit(False), "credentials_present": F.col("provider") != "click", "kill_switch": F.lit(False)})
    states = reporting.connection_states(policies, reporting.quota_state(calls, limits, ["provider"]))
    return states.groupBy("state").agg(F.count("*").alias("providers"))


CHAIN_TEXT = "seq::VARCHAR || '|' || entity::VARCHAR || '|USER||' || type || '|event|' || event_id::VARCHAR || '|' || props || '|' || epoch_us(ts)::VARCHAR"


@query("X7, W3, Z4", f"""
WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS seq FROM log),
chain AS (SELECT entity, seq, value, sha256('' || '|' || {CHAIN_TEXT}) AS hash FROM numbered WHERE seq = 1
  UNION ALL SELECT n.entity, n.seq, n.value, sha256(c.hash || '|' || n.seq::VARCHAR || '|' || n.entity::VARCHAR || '|USER||' || n.type
   || '|event|' || n.event_id::VARCHAR || '|' || n.props || '|' || epoch_us(n.ts)::VARCHAR) FROM numbered n JOIN chain c
   ON n.entity = c.entity AND n.seq = c.seq + 1)
SELECT entity::VARCHAR AS tenant_id, count(*) AS events, min(seq) FILTER (value > 100) AS first_broken_seq,
 arg_max(hash, seq) AS last_hash FROM chain GROUP BY 1
""", "log")
def audit_chain(spark, root):
    from pyspark.sql import Window
    rows = bound(spark, root, "log")
    # positions by a prefix scan so that no task orders a whole tenant
    rows = scans.running_total(rows.withColumn("one", F.lit(1)), ["entity"], ["ts", "event_id"], "one", "seq")
    events = rows.select(
        F.col("seq").cast("bigint").alias("seq"), F.col("entity").cast("string").alias("tenant_id"), F.lit("USER").alias("actor_kind"),
        F.lit(None).cast("string").alias("actor_id"), F.col("type").alias("action"), F.lit("event").alias("entity_type"),
        F.col("event_id").cast("string").alias("entity_id"), F.col("props").alias("payload_json"),
        micros("ts").cast("string").alias("created_at"), "value")
    tails = spark.createDataFrame([], "tenant_id string, hash string")
    log = chain.build_chain(events, tails)
    edited = log.withColumn("payload_json", F.when(F.col("value") > 100, F.lit("{}")).otherwise(F.col("payload_json")))
    last = log.groupBy("tenant_id").agg(F.max_by("hash", "seq").alias("last_hash"))
    return chain.verify_chain(edited).join(last, "tenant_id").select("tenant_id", "events", "first_broken_seq", "last_hash")


@query("E11, S12", """
WITH f AS (SELECT entity, type AS field, ts, event_id, CASE WHEN value < 1 THEN NULL ELSE props END AS v,
  value < 30 AS human FROM log),
gone AS (SELECT entity, field, max(event_id) AS g FROM f WHERE v IS NULL AND human GROUP BY 1, 2),
alive AS (SELECT f.* FROM f LEFT JOIN gone USING (entity, field) WHERE v IS NOT NULL AND (g IS NULL OR event_id > g))
SELECT entity, field, arg_max(v, struct_pack(h := human, e := event_id)) AS value, bool_or(human) AS human_override
FROM alive GROUP BY 1, 2
""", "log")
def profile_field_state(spark, root):
    entries = bound(spark, root, "log").select(
        "entity", F.col("type").alias("field"), "event_id", F.when(F.col("value") >= 1, F.col("props")).alias("value"),
        (F.col("value") < 30).alias("human"))
    return folds.field_state(entries, ["entity", "field"], ["event_id"])


SPEC = [("view", "text", True), ("click", "list", True), ("purchase", "number", False), ("signup", "bool", False), ("refund", "text", False)]


@query("J13, A25, R1", """
WITH spec AS (SELECT * FROM (VALUES (0, 'view', TRUE), (1, 'click', TRUE), (2, 'purchase', FALSE), (3, 'signup', FALSE),
  (4, 'refund', FALSE)) t(pos, field, req)), have AS (SELECT DISTINCT entity, type FROM log WHERE value > 20),
grid AS (SELECT e.entity, s.*, h.type IS NOT NULL AS known FROM (SELECT DISTINCT entity FROM log) e, spec s
  LEFT JOIN have h ON h.entity = e.entity AND h.type = s.field)
SELECT entity AS profile_id, sum(CASE WHEN known THEN 1 ELSE 0 END)::BIGINT AS known, count(*) AS total,
 CAST(round_even(sum(CASE WHEN known THEN 1 ELSE 0 END) / count(*) * 100, 0) AS BIGINT) AS score,
 coalesce(string_agg(CASE WHEN req AND NOT known THEN field END, ',' ORDER BY pos), '') AS missing_required FROM grid GROUP BY 1
""", "log")
def profile_completeness(spark, root):
    rows = bound(spark, root, "log").select(F.col("entity").alias("profile_id"), F.col("type").alias("field"), "value")
    have = rows.filter("value > 20").groupBy("profile_id", "field").agg(F.max(F.col("value").cast("string")).alias("value"))
    fields = joins.spec_join(rows.select("profile_id").distinct(), "profile_id", have, SPEC)
    return reporting.profile_completeness(fields).select(
        "profile_id", "known", "total", "score", F.array_join("missing_required", ",").alias("missing_required"))


@query("K13", """
WITH s AS (SELECT entity, ts, event_id, CASE type WHEN 'purchase' THEN 'PAID' WHEN 'error' THEN 'REFUNDED' WHEN 'view' THEN 'PLANNED'
  WHEN 'click' THEN 'SUBMITTED' ELSE 'DECLINED' END AS st FROM log),
r AS (SELECT entity, max(event_id) FILTER (st = 'REFUNDED') AS ref, arg_max(st, event_id) AS status FROM s GROUP BY 1)
SELECT r.entity AS item_id, r.status, epoch_us(min(s.ts) FILTER (s.st = 'PAID' AND (r.ref IS NULL OR s.event_id > r.ref))) AS paid_us
FROM r JOIN s ON s.entity = r.entity GROUP BY 1, 2
""", "log")
def plan_item_state(spark, root):
    kinds = {"purchase": "PAID", "error": "REFUNDED", "view": "PLANNED", "click": "SUBMITTED", "signup": "DECLINED"}
    rows = bound(spark, root, "log").select(F.col("entity").alias("item_id"), "ts", "event_id", tx.lookup("type", kinds).alias("status"))
    return folds.plan_state(rows, ["item_id"], ["event_id"], "ts").select("item_id", "status", micros("paid_at").alias("paid_us"))


@query("K14", """
SELECT e.entity AS service_id, arg_max(props, event_id) FILTER (type = 'view') AS note,
 coalesce(arg_max(CASE WHEN value > 20 THEN 'PARTNER' ELSE 'NONE' END, event_id) FILTER (type = 'purchase'), 'NONE') AS relation,
 coalesce(arg_max(type, event_id) FILTER (type IN ('error', 'signup')) = 'error', FALSE) AS manual_review_required
FROM log e GROUP BY 1
""", "log")
def service_edit_state(spark, root):
    from wayfold.plans.promotion import service_edits
    kinds = {"view": "NOTE", "purchase": "RELATION", "error": "REVIEW_RAISED", "signup": "REVIEW_RESOLVED"}
    log = bound(spark, root, "log").select(
        F.col("entity").alias("service_id"), tx.lookup("type", kinds).alias("kind"), F.col("props").alias("text"),
        F.when(F.col("value") > 20, "PARTNER").otherwise("NONE").alias("relation"), F.col("event_id").alias("seq"))
    services = log.select("service_id").distinct()
    return service_edits(services, log).select("service_id", "note", "relation", "manual_review_required")


@query("A30", """
SELECT entity AS campaign_id, CAST(floor(value / 100) AS BIGINT) AS domain, sum(CASE WHEN type = 'view' THEN 1 ELSE 0 END)::BIGINT AS searches_used,
 sum(CASE WHEN type = 'click' THEN 1 ELSE 0 END)::BIGINT AS pages_fetched, sum(CASE WHEN type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS emails_sent,
 round(sum(CASE WHEN type = 'purchase' THEN value ELSE 0 END), 2) AS spend FROM log GROUP BY 1, 2
""", "log")
def budget_counters(spark, root):
    n = lambda kind: (F.col("type") == kind).cast("bigint")
    work = bound(spark, root, "log").select(
        F.col("entity").alias("campaign_id"), F.floor(F.col("value") / 100).cast("bigint").alias("domain"), n("view").alias("searches"),
        n("click").alias("pages"), n("purchase").alias("emails"), F.when(F.col("type") == "purchase", F.col("value")).otherwise(0.0).alias("spend"))
    return reporting.budget_use(work, ["campaign_id", "domain"]).withColumn("spend", F.round("spend", 2))


@query("J19, L12", """
SELECT entity, kind, count(*) AS rows, epoch_us(max(ts)) AS newest_us FROM (
 SELECT entity, ts, 'submissions' AS kind FROM log WHERE type = 'view' UNION ALL SELECT entity, ts, 'responses' FROM log WHERE type = 'click'
 UNION ALL SELECT entity, ts, 'placements' FROM log WHERE type = 'purchase') GROUP BY 1, 2
""", "log")
def entity_history(spark, root):
    rows = bound(spark, root, "log").select("entity", "ts", "type")
    pick = lambda kind: rows.filter(F.col("type") == kind).select("entity", "ts")
    history = joins.kinds_union(submissions=pick("view"), responses=pick("click"), placements=pick("purchase"))
    return history.groupBy("entity", "kind").agg(F.count("*").alias("rows"), F.unix_micros(F.max("ts")).alias("newest_us"))


@query("S8, X1", """
SELECT entity, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS rows FROM log GROUP BY 1
""", "log")
def json_column_decode(spark, root):
    rows = bound(spark, root, "log").withColumn("p", F.from_json("props", "k bigint"))
    return rows.groupBy("entity").agg(F.sum("p.k").alias("total"), F.count("*").alias("rows"))


@query("A1, F1, S1", """
SELECT entity, type, count(*) AS rows FROM log GROUP BY 1, 2
""", "log")
def counts_by_type(spark, root):
    return bound(spark, root, "log").groupBy("entity", "type").agg(F.count("*").alias("rows"))


@query("K5, W1", """
WITH base AS (SELECT entity AS target_id, CAST(least(value, 100) AS BIGINT) AS score, ts, event_id, FALSE AS human FROM
  (SELECT * REPLACE (floor(value) AS value) FROM log) WHERE type <> 'error'
 UNION ALL SELECT entity, CAST(value AS BIGINT), ts, event_id, TRUE FROM (SELECT * REPLACE (floor(value) AS value) FROM log) WHERE type = 'error' AND value <= 100)
SELECT target_id, arg_max(score, struct_pack(a := ts, e := event_id)) AS score, arg_max(human, struct_pack(a := ts, e := event_id)) AS human_override
FROM base GROUP BY 1
""", "log")
def score_with_override(spark, root):
    from wayfold.plans.scoring import score_overrides
    rows = bound(spark, root, "log").select(
        F.col("entity").alias("target_id"), F.floor("value").cast("bigint").alias("score"), F.col("ts").alias("created_at"),
        F.col("event_id").alias("seq"), "type", F.lit("checked by hand").alias("reason"))
    computed = rows.filter("type <> 'error'").withColumn("score", F.least("score", F.lit(100)))
    log = score_overrides(computed, rows.filter("type = 'error'"))
    return latest.newest_per_key(log, ["target_id"], ["created_at", "seq"], ["score", "human_override"])


@query("A31, J5", """
SELECT entity AS tenant_id, step, CASE WHEN step = 'track' THEN v WHEN step = 'profile' THEN c ELSE p END AS rows,
 CASE WHEN (CASE WHEN step = 'track' THEN v WHEN step = 'profile' THEN c ELSE p END) > 0 THEN 'DONE' ELSE 'TODO' END AS state
FROM (SELECT entity, count(*) FILTER (type = 'view' AND value > 60) AS v, count(*) FILTER (type = 'click' AND value > 60) AS c,
  count(*) FILTER (type = 'purchase' AND value > 60) AS p FROM log GROUP BY 1), (VALUES ('track'), ('profile'), ('campaign')) t(step)
""", "log")
def setup_checklist(spark, root):
    rows = bound(spark, root, "log").select(F.col("entity").alias("tenant_id"), "type", "value")
    big = rows.filter("value > 60")
    pick = lambda kind: big.filter(F.col("type") == kind)
    return reporting.setup_steps(rows.select("tenant_id").distinct(), track=pick("view"), profile=pick("click"), campaign=pick("purchase"))


@query("A29", """
WITH c AS (SELECT entity, count(*) FILTER (type = 'view' AND value > 60) AS a, count(*) FILTER (type = 'click' AND value > 60) AS b,
 count(*) FILTER (type = 'purchase') AS d FROM log GROUP BY 1)
SELECT entity AS tenant_id, 0 AS rank, 'approve' AS action, a AS items FROM c WHERE a > 0
UNION ALL SELECT entity, 1, 'review', b FROM c WHERE b > 0 UNION ALL SELECT entity, 2, 'follow_up', d FROM c WHERE d > 0
""", "log")
def next_best_actions(spark, root):
    n = lambda cond: F.count_if(F.expr(cond))
    counts = bound(spark, root, "log").groupBy(F.col("entity").alias("tenant_id")).agg(
        n("type = 'view' AND value > 60").alias("approve"), n("type = 'click' AND value > 60").alias("review"),
        n("type = 'purchase'").alias("follow_up"))
    return reporting.next_actions(counts)


@query("L8", """
SELECT entity AS target_id, 'HUMAN_ACTION' AS method, count(*) AS sent FROM log WHERE type = 'purchase' GROUP BY 1
""", "log")
def manual_submissions(spark, root):
    rows = bound(spark, root, "log")
    tasks = rows.select(F.col("event_id").alias("task_id"), F.col("entity").alias("target_id"), F.col("entity").alias("route_id"),
                        F.col("type").alias("provider"), F.col("value").alias("cost"))
    states = {"purchase": "SUBMITTED", "error": "BROKEN_ROUTE"}
    events = rows.select(F.col("event_id").alias("task_id"), tx.lookup("type", states).alias("status"), "ts")
    sent, _broken = outreach.task_effects(events, tasks)
    return sent.groupBy("target_id", "method").agg(F.count("*").alias("sent"))
