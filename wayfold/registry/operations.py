"""Outreach and operations queries: approvals, gates, tasks, sealed values, payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import keys as ky
from wayfold.functions import score as sc
from wayfold.functions import text as tx
from wayfold.functions.when import days_until, moment
from wayfold.operators import graph, latest, upsert
from wayfold.plans import contacts, dossier, entities, outreach, page_facts, promotion, reporting
from wayfold.registry.base import AS_OF, TRADE_AS_OF, bound, micros, query
from wayfold.session import shared_folder
from wayfold.sources import ingest, payloads, tables


@query("J20, L2", """
WITH a AS (SELECT *, struct_pack(a := created_at, b := seq) AS k FROM score_log),
l AS (SELECT target_id, arg_max(decision, k) FILTER (flag <> 'R') AS ok, arg_max(CASE WHEN line = 'F' THEN 'edited' ELSE '' END, k) FILTER (flag = 'R') AS gone,
  count(*) FILTER (flag <> 'R') AS live, count(*) FILTER (flag = 'R') AS dead FROM a GROUP BY 1)
SELECT t.target_id, CASE WHEN coalesce(l.live, 0) = 0 AND coalesce(l.dead, 0) > 0 THEN coalesce(nullif(l.gone, ''), 'Approval was invalidated because the draft changed after approval')
 WHEN coalesce(l.live, 0) = 0 THEN 'No approval on record' WHEN t.status = 'DISCOVERED' THEN 'Approved draft no longer exists'
 WHEN l.ok <> (CASE WHEN t.cost > 250000 THEN 'ALLOW' ELSE 'BLOCK' END) THEN 'Approved payload no longer matches the draft — a material field changed after approval' END AS approval_reason
FROM targets t LEFT JOIN l ON l.target_id = t.target_id
""", "targets score_log")
def approval_validity(spark, root):
    dead = F.col("flag") == "R"
    approvals = bound(spark, root, "score_log").select(
        "target_id", F.col("target_id").alias("draft_id"), F.col("decision").alias("payload_hash"), F.col("amount").alias("cost"),
        F.col("created_at").alias("approved_at"), "seq", F.when(dead, F.col("created_at")).alias("invalidated_at"),
        F.when(dead & (F.col("line") == "F"), "edited").alias("invalidation_reason"))
    targets = bound(spark, root, "targets")
    drafts = targets.filter("status <> 'DISCOVERED'").select(F.col("target_id").alias("draft_id"),
                                                             F.when(F.col("cost") > 250000, "ALLOW").otherwise("BLOCK").alias("payload_hash"))
    return outreach.approval_validity(targets.select("target_id"), approvals, drafts).select("target_id", "approval_reason")


@query("L3, A5, W4", """
SELECT t.target_id, CAST((t.status NOT IN ('APPROVED', 'READY'))::INT + (c.mode = 'SCOUT')::INT + (c.tenant_id % 7 = 0)::INT + (t.cost > 400000)::INT
 + (t.cost > 450000)::INT + (c.tenant_id = 3)::INT + (t.status IN ('OPTED_OUT', 'BLOCKED', 'DECLINED', 'BOUNCED'))::INT AS BIGINT) AS reasons
FROM targets t JOIN campaigns c ON c.campaign_id = t.campaign_id
""", "targets campaigns")
def send_gate(spark, root):
    rows = bound(spark, root, "targets").join(bound(spark, root, "campaigns").select("campaign_id", "tenant_id", "mode"), "campaign_id")
    rows = rows.withColumns({
        "approval_valid": F.col("status").isin("APPROVED", "READY"), "approval_reason": F.lit("No approval on record"), "send_stop": F.lit(False),
        "sender_ready": F.col("tenant_id") % 7 != 0, "campaign_sent": F.when(F.col("cost") > 400000, 50).otherwise(0), "daily_send_limit": F.lit(50),
        "tenant_sent": F.when(F.col("cost") > 450000, 10).otherwise(0), "warmup_cap": F.lit(10),
        "bounce_rate": F.when(F.col("tenant_id") == 3, 0.2).otherwise(0.0), "has_method": F.lit(True), "recipient_hash": F.lit("h"),
        "value_hash": F.lit("h"), "blockers": F.array().cast("array<string>"), "target_status": F.col("status"), "cooldown_days": F.lit(None).cast("int")})
    return outreach.send_gate(rows).select("target_id", F.size("held_because").cast("bigint").alias("reasons"))


TASK_SQL = """SELECT target_id, seq, outlet_id, line, flag, CASE WHEN risk_score >= 90 THEN 'NO_API' WHEN risk_score >= 70 THEN 'CAPTCHA' WHEN risk_score >= 50 THEN 'LOGIN'
 WHEN flag = 'A' THEN 'NO_API' WHEN decision = 'LEGAL_REVIEW' THEN 'LEGAL' WHEN flag = 'R' THEN 'PAID' ELSE 'JUDGMENT' END AS reason_key FROM score_log"""


def tasks(spark, root):
    risk, flag = F.col("risk_score"), F.col("flag")
    rows = bound(spark, root, "score_log").withColumns({
        "route_method": F.when(risk >= 90, F.lit(None)).when(flag == "A", "WEB_FORM").otherwise("EMAIL"), "requires_captcha": risk.between(70, 89),
        "requires_login": risk.between(50, 69), "cost_model": F.when(flag == "R", "PAID_CONSIDERATION").otherwise("UNKNOWN"),
        "destination": F.lit(None).cast("string"), "url": F.lit("https://a.example/"), "instructions": F.lit(None).cast("string"),
        "outlet_name": F.format_string("Supplier %d", "outlet_id")})
    return outreach.human_tasks(rows)


@query("L7, X8", f"SELECT target_id, seq, outlet_id, reason_key, 'Submit to Supplier ' || outlet_id AS title, CASE WHEN reason_key = 'JUDGMENT' THEN 'Under 5 minutes' ELSE '5–15 minutes' END AS effort FROM ({TASK_SQL})",
       "score_log")
def human_tasks(spark, root):
    return tasks(spark, root).select("target_id", "seq", "outlet_id", "reason_key", "title", "effort")


@query("A27", f"""
SELECT line AS tenant_id, CASE reason_key WHEN 'CAPTCHA' THEN 'CAPTCHA walls' WHEN 'LOGIN' THEN 'Login required' WHEN 'PAID' THEN 'Paid submissions' WHEN 'LEGAL' THEN 'Legal review' ELSE 'Web forms' END AS "group",
 count(*) AS tasks, string_agg(DISTINCT reason_key, ',' ORDER BY reason_key) AS reasons FROM ({TASK_SQL}) WHERE flag <> 'N' GROUP BY 1, 2
""", "score_log")
def task_groups(spark, root):
    rows = tasks(spark, root).withColumns({"tenant_id": F.col("line"), "status": F.when(F.col("flag") == "N", "SUBMITTED").otherwise("OPEN")})
    return reporting.task_groups(rows).withColumn("reasons", F.array_join("reasons", ","))


@query("O2, D5", f"""
SELECT event_id AS task_id, CAST(round_even(CASE WHEN type <> 'view' THEN -(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts + INTERVAL 20 DAY)) / 86400000000.0 END, 0) AS BIGINT) AS deadline_days,
 type = 'signup' AND ts + INTERVAL 10 DAY > TIMESTAMP '{AS_OF}' AS snoozed FROM log WHERE type <> 'error'
""", "log")
def task_queue(spark, root):
    kind = F.col("type")
    rows = bound(spark, root, "log").select(
        F.col("event_id").alias("task_id"), F.col("ts").alias("created_at"), F.when(kind != "view", F.col("ts") + F.expr("INTERVAL 20 DAYS")).alias("deadline"),
        F.when(kind == "signup", F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("snooze_until"),
        F.when(kind == "error", "SUBMITTED").when(kind == "signup", "SNOOZED").otherwise("OPEN").alias("status"))
    return reporting.task_queue(rows, AS_OF).select("task_id", "deadline_days", "snoozed")


@query("D5", f"""
SELECT event_id, CAST(greatest(1, round_even(-(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts + INTERVAL 60 DAY)) / 86400000000.0, 0)) AS BIGINT) AS eligible_in_days FROM log
""", "log")
def days_until_eligible(spark, root):
    rows = bound(spark, root, "log").withColumn("due", F.col("ts") + F.expr("INTERVAL 60 DAYS"))
    return rows.select("event_id", days_until("due", AS_OF, 1).alias("eligible_in_days"))


@query("L7", "SELECT campaign_id, t.n AS title, CASE WHEN t.n LIKE 'Audiomack%' THEN tenant_id % 2 = 0 AND segment <> 'BUILDING' ELSE promotion_budget IS NOT NULL END AS eligible FROM campaigns, (VALUES "
       + ", ".join("('" + r[1].replace("'", "''") + "')" for r in rules.RELEASE_TASKS) + ") t(n)", "campaigns")
def release_tasks(spark, root):
    rows = bound(spark, root, "campaigns").withColumns({
        "isrc": F.when(F.col("tenant_id") % 2 == 0, "X"), "primary_genre": F.when(F.col("segment") != "BUILDING", F.col("segment")),
        "distributed": F.when(F.col("promotion_budget").isNotNull(), True)})
    return outreach.release_tasks(rows).select("campaign_id", "title", "eligible")


RECORDING_SQL = """SELECT service_id AS recording_id, size % 2 = 0 AS isrc, size % 3 = 0 AS upc, kind = 'PROMO' AS dist, size > 25 AS rights, size % 5 = 0 AS writers,
 kind <> 'SMALL' AS publisher, kind = 'LARGE' AS splits FROM services"""


def recordings(spark, root):
    size, kind = F.col("size"), F.col("kind")
    return bound(spark, root, "services").select(
        F.col("service_id").alias("recording_id"), F.when(size % 2 == 0, "I").alias("isrc"), F.when(size % 3 == 0, "U").alias("upc"),
        F.when(kind == "PROMO", True).alias("distributed"), (size > 25).alias("attested"),
        F.when(size % 5 == 0, F.array("name")).alias("writers"), F.when(kind != "SMALL", F.col("brand")).alias("publisher"),
        F.when(kind == "LARGE", True).alias("splits_confirmed"), "name", "brand", "size")


@query("A25, E8", f"""
WITH r AS ({RECORDING_SQL}), n AS (SELECT *, isrc::INT + upc::INT + dist::INT + rights::INT + writers::INT + publisher::INT + splits::INT AS p FROM r)
SELECT recording_id, p::BIGINT AS passed, CAST(round_even(p / 7 * 100, 0) AS BIGINT) AS score, concat_ws(',', CASE WHEN NOT isrc THEN 'isrc' END, CASE WHEN NOT upc THEN 'upc' END,
 CASE WHEN NOT dist THEN 'distribution' END, CASE WHEN NOT rights THEN 'rights' END, CASE WHEN NOT writers THEN 'writers' END, CASE WHEN NOT publisher THEN 'publisher' END,
 CASE WHEN NOT splits THEN 'splits' END) AS missing, NOT rights AS blocked FROM n
""", "services")
def release_readiness(spark, root):
    rec = recordings(spark, root)
    out = entities.release_readiness(rec, rec.filter("attested"))
    return out.select("recording_id", "passed", "score", F.array_join("missing", ",").alias("missing"), "blocked")


@query("L10, A25", """
SELECT service_id AS recording_id, concat_ws(',', CASE WHEN size <= 25 THEN 'rights_attestation' END, CASE WHEN size % 3 = 0 THEN 'mood' END) AS missing, size > 25 AND size % 3 <> 0 AS allowed FROM services
""", "services")
def campaign_gate(spark, root):
    rec = recordings(spark, root).withColumn("profile_id", F.col("recording_id"))
    gaps = F.array_compact(F.array(F.when(F.col("size") % 3 == 0, F.lit("mood"))))
    ready = rec.select("profile_id", gaps.alias("missing_required"), (F.size(gaps) == 0).alias("ready"))
    out = reporting.campaign_gate(rec, rec.filter("attested"), ready)
    return out.select("recording_id", F.array_join("missing", ",").alias("missing"), "allowed")


@query("L10, E11", """
SELECT entity AS target_id, arg_max(props, event_id) FILTER (type = 'view') AS tags, arg_max(type, event_id) FILTER (value > 20) AS owner FROM log GROUP BY 1
""", "log")
def target_edits(spark, root):
    log = bound(spark, root, "log").select(F.col("entity").alias("target_id"), F.col("event_id").alias("seq"),
                                           F.when(F.col("type") == "view", F.col("props")).alias("tags"), F.when(F.col("value") > 20, F.col("type")).alias("owner"))
    return reporting.newest_edits(log, ["target_id"], ["tags", "owner"])


@query("E8, W1", """
SELECT target_id AS recording_id, seq FROM (SELECT target_id, seq, row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, seq DESC) AS rn FROM score_log WHERE flag <> 'R') WHERE rn = 1
""", "score_log")
def active_attestations(spark, root):
    log = bound(spark, root, "score_log").select(F.col("target_id").alias("recording_id"), "seq", F.col("created_at").alias("attested_at"),
                                                 F.when(F.col("flag") == "R", F.col("created_at")).alias("revoked_at"))
    return entities.active_attestations(log).select("recording_id", "seq")


@query("E8", "SELECT service_id AS version_of, brand AS publisher, 'REMIX' AS version_type, FALSE AS master_version FROM services WHERE kind = 'PROMO'", "services")
def recording_versions(spark, root):
    rec = recordings(spark, root).withColumn("version_of", F.col("recording_id"))
    wanted = bound(spark, root, "services").filter("kind = 'PROMO'").select(F.col("service_id").alias("source_id"), F.lit("REMIX").alias("version_type"))
    out = entities.recording_versions(rec.select("recording_id", "version_of", F.col("brand").alias("publisher")), wanted)
    return out.select("version_of", "publisher", "version_type", "master_version")


@query("S12", """
SELECT service_id, CASE WHEN size % 4 = 0 THEN NULL ELSE name END AS title, CASE WHEN size % 4 = 0 THEN '' ELSE brand END AS writers,
 CASE WHEN kind = 'PROMO' THEN NULL WHEN kind = 'LARGE' THEN TRUE ELSE FALSE END AS distributed, CASE WHEN size % 3 = 0 THEN NULL ELSE size * 1000 END AS streams,
 CAST(size + size * 2 AS BIGINT) AS monthly_total FROM services
""", "services")
def typed_track_rows(spark, root):
    size = F.col("size")
    none = F.lit(None).cast("string")
    raw = bound(spark, root, "services").select(
        "service_id", F.when(size % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "name")).alias("title"), none.alias("isrc"), none.alias("iswc"),
        none.alias("upc"), none.alias("publisher"), F.when(size % 4 == 0, " , ").otherwise(F.concat("brand", F.lit(", ,"))).alias("writers"),
        none.alias("producers"), none.alias("alternate_titles"), none.alias("reporting_platforms"),
        F.when(F.col("kind") == "PROMO", "UNKNOWN").when(F.col("kind") == "LARGE", "Yes").otherwise("no").alias("distributed"), none.alias("splits_confirmed"),
        F.when(size % 3 == 0, "n/a").otherwise(F.format_string("%d,000", size)).alias("streams"), F.format_string("%d, x, %d", size, size * 2).alias("monthly_streams"))
    rows = ingest.track_rows(raw)
    total = F.aggregate("monthly_streams", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("service_id", "title", F.array_join("writers", ",").alias("writers"), "distributed", "streams", total.alias("monthly_total"))


@query("L9, J4", """
WITH t AS (SELECT DISTINCT outlet_id, target_id FROM score_log), s AS (SELECT t.outlet_id, count(*) AS n FROM score_log l JOIN t ON t.target_id = l.target_id AND t.outlet_id = l.outlet_id WHERE l.flag = 'A' GROUP BY 1),
r AS (SELECT outlet_id, count(*) AS n, count(*) FILTER (line = 'F') AS acc FROM score_log WHERE flag = 'R' GROUP BY 1)
SELECT o.outlet_id, coalesce(s.n, 0) AS submissions, coalesce(r.n, 0) AS responses, coalesce(r.acc, 0) AS accepted_responses FROM outlets o LEFT JOIN s ON s.outlet_id = o.outlet_id LEFT JOIN r ON r.outlet_id = o.outlet_id
""", "outlets score_log")
def relationship_list(spark, root):
    outlets = bound(spark, root, "outlets")
    log = bound(spark, root, "score_log").withColumns({"pair": F.concat_ws("-", "target_id", "outlet_id"), "one": F.lit(1)})
    targets = log.select(F.col("pair").alias("target_id"), "outlet_id", F.col("one").alias("tenant_id"), F.lit("SENT").alias("status")).distinct()
    events = log.select(F.col("pair").alias("target_id"), F.col("one").alias("tenant_id"), "flag", F.when(F.col("line") == "F", "ACCEPT").otherwise("REPLY").alias("kind"))
    rel = outlets.select(F.lit(1).alias("tenant_id"), F.col("outlet_id").alias("relationship_id"), "outlet_id", moment(TRADE_AS_OF).alias("next_eligible_at"))
    notes = spark.createDataFrame([], "tenant_id int, relationship_id bigint")
    out = reporting.relationship_list(rel, outlets, targets, events.filter("flag = 'A'"), events.filter("flag = 'R'"), notes, TRADE_AS_OF)
    return out.select("outlet_id", "submissions", "responses", "accepted_responses")


@query("A4", f"""
SELECT entity AS contact_id, CAST(round_even(CASE WHEN (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 86400000000.0 < 30 THEN 30 - (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 86400000000.0 END, 0) AS BIGINT) AS cooldown_days
FROM log WHERE type = 'purchase' GROUP BY 1
""", "log")
def recipient_cooldowns(spark, root):
    rows = bound(spark, root, "log")
    sends = rows.filter("type = 'purchase'").select(F.col("event_id").alias("target_id"), F.col("ts").alias("sent_at"))
    targets = rows.select(F.col("event_id").alias("target_id"), F.col("entity").alias("contact_id"))
    return outreach.cooldowns(sends, targets, AS_OF).select("contact_id", "cooldown_days")


@query("A5", """
SELECT entity AS tenant_id, CASE WHEN count(*) FILTER (type = 'view') > 0 THEN count(*) FILTER (type = 'error') / count(*) FILTER (type = 'view') ELSE 0.0 END::DOUBLE AS bounce_rate FROM log GROUP BY 1
""", "log")
def bounce_rates(spark, root):
    rows = bound(spark, root, "log").select(F.col("entity").alias("tenant_id"), F.when(F.col("type") == "view", F.col("ts")).alias("sent_at"),
                                            F.when(F.col("type") == "error", "BOUNCED").otherwise("SENT").alias("status"))
    return outreach.bounce_rates(rows)


@query("X4", "SELECT campaign_id, TRUE AS opens, TRUE AS wrong_key_is_null FROM campaigns", "campaigns")
def sealed_addresses(spark, root):
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    rows = bound(spark, root, "campaigns").select("campaign_id", "name", ky.seal("name", key).alias("sealed"))
    return rows.select("campaign_id", (ky.unseal("sealed", key) == F.col("name")).alias("opens"), ky.unseal("sealed", other).isNull().alias("wrong_key_is_null"))


@query("K12, W7", """
WITH r AS (SELECT entity, type, event_id, CAST(ts AS DATE) AS day FROM log), n AS (SELECT entity, type, arg_max(day, event_id) AS day FROM r GROUP BY 1, 2)
SELECT r.event_id, r.day <> n.day AS superseded FROM r JOIN n ON n.entity = r.entity AND n.type = r.type
""", "log")
def evidence_superseded(spark, root):
    rows = bound(spark, root, "log").select("entity", "type", "event_id", F.to_date("ts").alias("retrieved_at"), F.lit(None).cast("string").alias("content_hash"))
    return promotion.evidence_view(rows, ["entity", "type"], ["event_id"], AS_OF).select("event_id", "superseded")


@query("S9", """
SELECT service_id AS payload_id, 1 AS rank, 'https://a.example/' || service_id AS url, name, brand AS description, FALSE AS restricted FROM services WHERE size > 10
UNION ALL SELECT service_id, 2, 'https://b.example/' || service_id, brand, NULL, FALSE FROM services WHERE size > 10
UNION ALL SELECT service_id, 1, NULL, name, NULL, TRUE FROM services WHERE size <= 10
""", "services")
def landed_payload_items(spark, root):
    s = bound(spark, root, "services")
    item = lambda host, name, text: F.struct(F.concat(F.lit(f"https://{host}.example/"), "service_id").alias("url"), name.alias("title"), text.alias("description"))
    web = F.to_json(F.struct(F.struct(F.array(item("a", F.col("name"), F.col("brand")), item("b", F.col("brand"), F.lit(None).cast("string"))).alias("results")).alias("web")))
    tracks = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("service_id").cast("string").alias("id"), "name")).alias("items")).alias("tracks")))
    search = F.col("size") > 10
    landed = s.select(F.col("service_id").alias("payload_id"), F.when(search, "web_search").otherwise("spotify").alias("provider"),
                      F.when(search, "brave").otherwise("tracks").alias("operation"), F.when(search, web).otherwise(tracks).alias("payload"))
    both = payloads.payload_items(landed, "web_search", "brave").unionByName(payloads.payload_items(landed, "spotify", "tracks"))
    return both.select("payload_id", "rank", "url", "name", "description", "restricted")


@query("S10", """
SELECT service_id AS track_id, brand AS playlist_id, TRUE AS observed, CAST(service_id * 10 + 2 AS BIGINT) AS position FROM services WHERE size > 10
UNION ALL SELECT -service_id - 1, brand, FALSE, NULL FROM services WHERE size <= 10
""", "services")
def placement_positions(spark, root):
    s = bound(spark, root, "services")
    pages = s.select(F.col("brand").alias("playlist_id"), (F.col("service_id") * 10).alias("offset"), F.array(F.lit(-999).cast("bigint"), F.col("service_id")).alias("track_ids"))
    wanted = s.select(F.col("brand").alias("playlist_id"), F.when(F.col("size") > 10, F.col("service_id")).otherwise(-F.col("service_id") - 1).alias("track_id"))
    return payloads.placement_position(pages, wanted).select("track_id", "playlist_id", "observed", "position")


@query("X8", """
SELECT campaign_id, l.label, CASE l.label WHEN 'Name' THEN name WHEN 'Budget' THEN coalesce(CAST(CAST(floor(promotion_budget) AS BIGINT) AS VARCHAR), 'UNKNOWN') ELSE 'UNKNOWN' END AS value FROM campaigns, (VALUES ('Name'), ('Budget'), ('ISRC')) l(label)
""", "campaigns")
def copy_ready_answers(spark, root):
    fields = outreach.copy_ready({"Name": "name", "Budget": F.floor("promotion_budget").cast("bigint"), "ISRC": F.lit("")})
    return bound(spark, root, "campaigns").select("campaign_id", F.explode(fields).alias("f")).select("campaign_id", "f.label", "f.value")


@query("A32", "SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS domain, count(*) FILTER (length(html) > 2000) AS page_ok_count FROM crawl GROUP BY 1", "crawl")
def readable_pages_per_domain(spark, root):
    from wayfold.functions.web import host_of
    rows = bound(spark, root, "crawl").select(host_of("url").alias("domain"), (F.length("html") > 2000).alias("ok"))
    return rows.groupBy("domain").agg(F.count_if("ok").alias("page_ok_count"))


@query("C4, T1, J6", """
WITH have AS (SELECT DISTINCT entity FROM log WHERE type = 'view' AND value > 60)
SELECT entity, min(kind) AS reason FROM (SELECT entity, 'Permanent bounce' AS kind FROM log WHERE type = 'error' AND value > 50) WHERE entity NOT IN (SELECT entity FROM have) GROUP BY 1
UNION ALL SELECT entity, 'kept' FROM have
""", "log")
def suppression_register(spark, root):
    rows = bound(spark, root, "log")
    shape = lambda df, why: df.select(F.lit(None).cast("bigint").alias("tenant_id"), F.col("entity").cast("string").alias("value_hash"),
                                      F.lit("GLOBAL").alias("scope"), F.lit(why).alias("reason"))
    register = shape(rows.filter("type = 'view' AND value > 60").select("entity").distinct(), "kept")
    out = contacts.suppress(register, shape(rows.filter("type = 'error' AND value > 50"), "Permanent bounce"))
    return out.select(F.col("value_hash").cast("bigint").alias("entity"), "reason")


@query("E5, S4", """
WITH RECURSIVE edges AS (SELECT service_id AS loser, service_id // 2 AS winner FROM services WHERE service_id % 2 = 0 AND service_id > 0 AND size > 15),
walk AS (SELECT loser, winner FROM edges UNION ALL SELECT w.loser, e.winner FROM walk w JOIN edges e ON e.loser = w.winner),
roots AS (SELECT loser, min(winner) AS root FROM walk GROUP BY 1)
SELECT coalesce(r.root, l.service_id) AS entity_id, count(*) AS rows FROM score_log l LEFT JOIN roots r ON r.loser = l.service_id GROUP BY 1
""", "score_log services")
def evidence_reparented(spark, root):
    s = bound(spark, root, "services")
    log = s.filter("service_id % 2 = 0 AND service_id > 0").select(
        F.lit("service").alias("entity_type"), F.col("service_id").alias("loser_id"), F.floor(F.col("service_id") / 2).cast("bigint").alias("winner_id"),
        F.col("service_id").alias("seq"), (F.col("size") <= 15).alias("undone"))
    live = graph.live_edges(log).select("loser", "winner")
    moved = graph.reparent(bound(spark, root, "score_log").select(F.col("service_id").alias("entity_id")), graph.merge_roots(live))
    return moved.groupBy("entity_id").agg(F.count("*").alias("rows"))


@query("L1, F10, F11, X6, H32", """
SELECT campaign_id, 'Submission — ' || name || ' — "' || segment || '" (new track)' AS subject, CASE WHEN tenant_id % 6 = 0 THEN 'NO_POSTAL_ADDRESS' END AS refused,
 CASE WHEN tenant_id % 5 = 0 THEN 'de' ELSE 'en' END AS language FROM campaigns
""", "campaigns")
def message_drafts(spark, root):
    none = F.array().cast("array<string>")
    blank = F.lit(None).cast("string")
    rows = bound(spark, root, "campaigns").select(
        F.col("campaign_id").alias("target_id"), F.col("name").alias("outlet_name"), F.col("name").alias("artist_name"), F.col("segment").alias("recording_title"),
        F.when(F.col("tenant_id") % 5 == 0, F.array(F.lit("de"))).otherwise(none).alias("outlet_languages"), "tenant_id").withColumns({
            "outlet_genres": F.array(F.lit("techno")), "microgenres": F.array(F.lit("techno")), "territory": F.lit("US"), "submissions_open": F.lit("OPEN"),
            "primary_genre": blank, "release_narrative": blank, "streams": F.lit(1200), "comparable_artists": none, "mood": F.array(F.lit("dark")),
            "reasons": F.array(F.struct(F.lit("+").alias("sign"), F.lit("Free submission").alias("text"))), "link": F.lit("https://l.example/1"),
            "sender_name": F.lit("Label"), "postal_address": F.when(F.col("tenant_id") % 6 != 0, F.lit("1 Road")), "address_source_url": F.lit("https://o.example/"),
            "recipient_hash": F.lit("h"), "from_email": F.lit("a@label.example")})
    providers = spark.createDataFrame([("open_web_fetch", False, True, False, None)],
                                      "provider string, may_embed boolean, may_send_to_llm boolean, may_train boolean, retention_days int")
    out = outreach.drafts(rows, outreach.usage_policies(providers))
    return out.select(F.col("target_id").alias("campaign_id"), "subject", "refused", "language")


@query("J21", """
SELECT o_custkey AS campaign_id, 'domain:d' || (o_orderkey % 5) || '.example' AS fallback_key, arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS owner_id
FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2
""")
def domain_fallback_owners(spark, root):
    t = bound(spark, root, "targets").withColumn("contact_id", F.col("target_id"))
    live = spark.read.parquet(f"{root}/orders.parquet").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("target_id"))
    marked = t.join(live.withColumn("live", F.lit(True)), "target_id", "left").withColumn("status", F.when(F.col("live"), F.col("status")).otherwise("DUPLICATE"))
    methods = t.select("contact_id", F.concat(F.lit("mail.d"), F.col("target_id") % 5, F.lit(".example")).alias("domain"))
    return entities.domain_fallback(marked, methods, ["created_at", "target_id"]).select("campaign_id", "fallback_key", "owner_id")


@query("U2, F5", """
SELECT service_id, count(*) AS urls FROM (SELECT service_id, 'https://s' || service_id || '.example/' AS u FROM services UNION SELECT service_id, 'https://s' || service_id || '.example/terms' FROM services WHERE size > 20
 UNION SELECT service_id, 'r' || target_id FROM score_log) GROUP BY 1
""", "services score_log")
def refetch_urls(spark, root):
    none = F.lit(None).cast("string")
    home = F.concat(F.lit("https://s"), "service_id", F.lit(".example/"))
    services = bound(spark, root, "services").select("service_id", home.alias("url"), F.when(F.col("size") > 20, F.concat(home, F.lit("terms"))).alias("terms_url"),
                                                     none.alias("pricing_url"), home.alias("submission_url"), none.alias("contact_url"))
    packets = bound(spark, root, "score_log").select("service_id", F.concat(F.lit("r"), "target_id").alias("source_url"))
    return promotion.refetch_urls(services, packets).groupBy("service_id").agg(F.count("*").alias("urls"))


@query("S5, C2", """
SELECT flag AS tenant_id, outlet_id, CASE WHEN f = 'U' THEN CASE WHEN s IS NOT NULL THEN 'V' ELSE 'U' END ELSE f END AS category, n AS independent_sources FROM (
 SELECT flag, outlet_id, arg_min(CASE WHEN line = 'F' THEN 'V' ELSE 'U' END, k) AS f, arg_min('V', k) FILTER (line = 'F') AS s, max(score) AS n
 FROM (SELECT *, struct_pack(a := created_at, b := seq, c := target_id) AS k FROM score_log) GROUP BY 1, 2)
""", "score_log")
def contact_method_snapshot(spark, root):
    rows = bound(spark, root, "score_log").select(
        F.col("flag").alias("tenant_id"), "outlet_id", "created_at", "seq", "target_id", F.when(F.col("line") == "F", "V").otherwise("U").alias("category"),
        F.col("score").alias("independent_sources"))
    base = rows.select("tenant_id", "outlet_id", "category", "independent_sources").limit(0)
    return upsert.upsert(base, rows, ["tenant_id", "outlet_id"], ["created_at", "seq", "target_id"],
                         {"category": upsert.strengthen_category("U", ["V"]), "independent_sources": "max"})


@query("L2, J3", """
WITH n AS (SELECT target_id, arg_max(score, struct_pack(a := created_at, b := seq)) AS score, min(outlet_id) AS outlet_id, count(*) FILTER (flag <> 'R') AS approvals FROM score_log GROUP BY 1)
SELECT t.campaign_id, t.target_id, o.outlet_name, n.score, n.approvals FROM targets t JOIN n ON n.target_id = t.target_id JOIN outlets o ON o.outlet_id = n.outlet_id
WHERE t.status IN ('DRAFTED', 'NEEDS_APPROVAL', 'APPROVED', 'READY')
""", "targets score_log outlets")
def approval_queue(spark, root):
    log = bound(spark, root, "score_log")
    targets = bound(spark, root, "targets").join(log.groupBy("target_id").agg(F.min("outlet_id").alias("outlet_id")), "target_id")
    drafts = targets.select("target_id", F.sha2(F.col("target_id").cast("string"), 256).alias("payload_hash"))
    approvals = log.select("target_id", F.when(F.col("flag") == "R", F.col("created_at")).alias("invalidated_at"))
    out = outreach.approval_queue(targets, bound(spark, root, "outlets"), drafts, log.select("target_id", "score", "created_at", "seq"), approvals)
    return out.select("campaign_id", "target_id", "outlet_name", "score", "approvals")


@query("L12, J19, J3, W12", f"""
WITH s AS (SELECT *, row_number() OVER w AS rn FROM score_log WINDOW w AS (PARTITION BY target_id ORDER BY created_at DESC, seq DESC)),
sub AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, seq DESC) AS k FROM score_log WHERE flag = 'N'),
res AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, seq DESC) AS k FROM score_log WHERE flag = 'R'),
pla AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, seq DESC) AS k FROM score_log WHERE flag = 'A'),
rec AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, seq DESC) AS k FROM score_log WHERE risk_score > 20),
dra AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, seq DESC) AS k FROM score_log WHERE line = 'O'),
met AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, seq DESC) AS k FROM score_log WHERE line = 'F')
SELECT t.target_id, c.name AS campaign_name, c.mode, o.outlet_name, t.status, s.score, s.risk_score, s.decision,
 'Draft ' || dra.seq AS draft, sha256(dra.target_id || '|' || dra.seq) AS payload_hash, met.decision AS category, met.score > 50 AS sendable,
 coalesce(a.n, 0) AS submissions_count, a.shown AS submissions, coalesce(b.n, 0) AS responses_count, b.shown AS responses,
 coalesce(p.n, 0) AS placements_count, p.shown AS placements, coalesce(r.n, 0) AS receipts_count, r.shown AS receipts
FROM targets t LEFT JOIN campaigns c ON c.campaign_id = t.campaign_id LEFT JOIN outlets o ON o.outlet_id = t.target_id % 50
LEFT JOIN s ON s.target_id = t.target_id AND s.rn = 1 LEFT JOIN dra ON dra.target_id = t.target_id AND dra.k = 1 LEFT JOIN met ON met.target_id = t.target_id AND met.k = 1
LEFT JOIN (SELECT target_id, count(*) AS n, string_agg(decision || ' ' || seq, ',' ORDER BY k) FILTER (k <= 2) AS shown FROM sub GROUP BY 1) a ON a.target_id = t.target_id
LEFT JOIN (SELECT target_id, count(*) AS n, string_agg(decision || ' ' || seq, ',' ORDER BY k) FILTER (k <= 2) AS shown FROM res GROUP BY 1) b ON b.target_id = t.target_id
LEFT JOIN (SELECT target_id, count(*) AS n, string_agg(CAST(CAST(floor(amount) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (k <= 2) AS shown FROM pla GROUP BY 1) p ON p.target_id = t.target_id
LEFT JOIN (SELECT target_id, count(*) AS n, string_agg(flag || ' ' || decision || ' s' || service_id || CASE WHEN created_at + INTERVAL 900 DAY <= TIMESTAMP '{TRADE_AS_OF}' THEN ' stale' ELSE '' END, ',' ORDER BY k) FILTER (k <= 2) AS shown
  FROM rec GROUP BY 1) r ON r.target_id = t.target_id
""", "targets campaigns outlets score_log")
def target_dossier(spark, root):
    log = bound(spark, root, "score_log").select(
        "target_id", "created_at", "seq", "score", "risk_score", "decision", "flag", "line", "amount", "service_id")
    named = lambda where, **values: dossier.Kind(log, F.expr(where), values)
    entry = F.concat_ws(" ", "decision", F.col("seq").cast("string"))
    none = F.array().cast("array<string>")
    out = dossier.target_dossiers(
        bound(spark, root, "targets").withColumn("outlet_id", F.col("target_id") % 50), bound(spark, root, "outlets"), bound(spark, root, "campaigns"),
        scores=named("true", score=F.col("score"), reasons=none), risks=named("true", risk_score=F.col("risk_score"), signals=none),
        decisions=named("true", decision=F.col("decision"), reasons=none),
        drafts=named("line = 'O'", subject=F.concat(F.lit("Draft "), "seq"), payload_hash=F.sha2(F.concat_ws("|", "target_id", "seq"), 256)),
        submissions=named("flag = 'N'", method=entry), responses=named("flag = 'R'", kind=entry), placements=named("flag = 'A'", value=F.floor("amount").cast("string")),
        evidence=named("risk_score > 20", supports_field=F.col("flag"), value=F.col("decision"), source_domain=F.concat(F.lit("s"), "service_id"),
                       confidence=F.col("score") / 100, stale_at=F.col("created_at") + F.expr("INTERVAL 900 DAYS")),
        methods=named("line = 'F'", category=F.col("decision"), sendable=F.col("score") > 50), as_of=TRADE_AS_OF, shown=2)
    listed = lambda name, one: F.when(F.col(f"{name}_count") > 0, F.array_join(F.transform(name, one), ",")).alias(name)
    return out.select(
        "target_id", "campaign_name", "mode", "outlet_name", "status", F.col("score.score").alias("score"), F.col("risk.risk_score").alias("risk_score"),
        F.col("decision.decision").alias("decision"), F.col("draft.subject").alias("draft"), F.col("draft.payload_hash").alias("payload_hash"),
        F.col("method.category").alias("category"), F.col("method.sendable").alias("sendable"), "submissions_count", listed("submissions", lambda x: x["method"]),
        "responses_count", listed("responses", lambda x: x["kind"]), "placements_count", listed("placements", lambda x: x["value"]), "receipts_count",
        listed("receipts", lambda x: F.concat(F.concat_ws(" ", x["supports_field"], x["value"], x["source_domain"]), F.when(x["stale"], " stale").otherwise(""))))


@query("S13, A14, K12, D1", f"""
WITH e AS (SELECT target_id, seq, outlet_id, flag AS field, decision AS value, CASE WHEN risk_score >= 10 THEN 's' || service_id % 7 || '.example' END AS source_domain,
  created_at + INTERVAL 900 DAY <= TIMESTAMP '{TRADE_AS_OF}' AS stale, line = 'O' AS official FROM score_log),
b AS (SELECT outlet_id, field, count(DISTINCT source_domain) AS corroborating_domains FROM e GROUP BY 1, 2)
SELECT e.*, b.corroborating_domains FROM e JOIN b ON b.outlet_id = e.outlet_id AND b.field = e.field
""", "score_log")
def claim_provenance(spark, root):
    claims = bound(spark, root, "score_log").select(
        "target_id", "seq", F.lit("outlet").alias("entity_type"), F.col("outlet_id").alias("entity_id"), F.col("flag").alias("supports_field"),
        F.col("decision").alias("value"), F.when(F.col("risk_score") >= 10, F.concat(F.lit("s"), F.col("service_id") % 7, F.lit(".example"))).alias("source_domain"),
        F.when(F.col("line") == "O", "OFFICIAL").otherwise("PRESS").alias("source_type"), (F.col("created_at") + F.expr("INTERVAL 900 DAYS")).alias("stale_at"))
    return page_facts.provenance(claims, TRADE_AS_OF).select(
        "target_id", "seq", F.col("entity_id").alias("outlet_id"), F.col("supports_field").alias("field"), "value", "source_domain", "stale", "official", "corroborating_domains")


@query("S2, J5", """
SELECT target_id, status, cost FROM targets WHERE target_id IN (SELECT service_id * 7 FROM services WHERE size <= 3)
""", "targets services")
def looked_up_targets(spark, root):
    path = f"{shared_folder(spark)}/targets-by-id-{uuid.uuid4().hex}"
    tables.write_keyed(bound(spark, root, "targets").select("target_id", "status", "cost"), path, "target_id")
    keys = bound(spark, root, "services").filter("size <= 3").select((F.col("service_id") * 7).alias("target_id"))
    return tables.lookup(spark, path, "target_id", keys).select("target_id", "status", "cost")


@query("F1, A1", """
SELECT entity % 25 AS tenant_id, type, count(*) AS rows FROM log WHERE entity % 25 IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1, 2
""", "log")
def counts_in_tenant_scope(spark, root):
    home = f"{shared_folder(spark)}/tenants-{uuid.uuid4().hex}"
    tables.TenantTables.write(bound(spark, root, "log").withColumn("tenant_id", F.col("entity") % 25), home, "log")
    tenants = spark.read.parquet(f"{root}/nation.parquet").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("tenant_id"))
    scope = tables.TenantTables(spark, home, tenants)
    return scope.read("log").groupBy(F.col("tenant_id").cast("bigint").alias("tenant_id"), "type").agg(F.count("*").alias("rows"))


@query("U5, A19", """
WITH d AS (SELECT service_id, flag AS signal, seq, 'rules' AS detector FROM score_log WHERE flag <> 'N' UNION ALL SELECT service_id, decision, seq + 1, 'class' FROM score_log WHERE line = 'F'
 UNION ALL SELECT service_id, flag, seq - 1, 'class' FROM score_log WHERE line = 'O')
SELECT service_id, signal, label, seq FROM (SELECT service_id, signal, detector || ' ' || signal AS label, seq, row_number() OVER (PARTITION BY service_id, signal ORDER BY seq, detector) AS rn FROM d) WHERE rn = 1
""", "score_log")
def signals_of_two_detectors(spark, root):
    log = bound(spark, root, "score_log")
    found = lambda where, signal, seq, detector: log.filter(where).select("service_id", F.expr(signal).alias("signal"), F.expr(seq).alias("seq"), F.lit(detector).alias("detector"))
    both = found("flag <> 'N'", "flag", "seq", "rules").unionByName(found("line = 'F'", "decision", "seq + 1", "class")).unionByName(found("line = 'O'", "flag", "seq - 1", "class"))
    packets = both.select("service_id", "seq", "detector", F.lit("stream_guarantees").alias("supports_field"), F.lit("x").alias("excerpt"), F.col("seq").cast("string").alias("source_url"),
                          F.struct("signal", F.concat_ws(" ", "detector", "signal").alias("label")).alias("value"))
    first = promotion.first_signals(packets, ["service_id"], ["seq", "detector"])
    return first.select("service_id", "signal", "label", F.col("source_url").cast("bigint").alias("seq"))


@query("H30", f"""
SELECT service_id, CASE WHEN t IN ({", ".join(f"'{x}'" for x in sorted({*rules.SERVICE_TYPE_TO_ALLOCATION.values()}))}) THEN t {" ".join(f"WHEN t = '{a}' THEN '{b}'" for a, b in rules.SERVICE_TYPE_TO_ALLOCATION.items())} ELSE 'OTHER' END AS category
FROM (SELECT service_id, [{", ".join(f"'{x}'" for x in [*rules.SERVICE_TYPE_TO_ALLOCATION, *sorted({*rules.SERVICE_TYPE_TO_ALLOCATION.values()}), "NOTHING KNOWN"])}][service_id % {len(rules.SERVICE_TYPE_TO_ALLOCATION) + len({*rules.SERVICE_TYPE_TO_ALLOCATION.values()}) + 1} + 1] AS t FROM services)
""", "services")
def allocation_of_service_types(spark, root):
    names = [*rules.SERVICE_TYPE_TO_ALLOCATION, *sorted({*rules.SERVICE_TYPE_TO_ALLOCATION.values()}), "NOTHING KNOWN"]
    kind = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("service_id") % len(names) + 1).cast("int"))
    return bound(spark, root, "services").select("service_id", tx.allocation_category(kind).alias("category"))
