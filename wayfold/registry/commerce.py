"""Campaign, target, service and outlet queries on the trade tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import score as sc
from wayfold.functions import text as tx
from wayfold.functions.when import moment
from wayfold.operators import folds, graph, joins, latest, quality, upsert
from wayfold.operators.labels import Labels
from wayfold.plans import contacts, entities, outreach, promotion, reporting, scoring
from wayfold.registry.base import TRADE_AS_OF, bound, micros, query
from wayfold.session import parts_for

NEWEST_SCORE = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, seq DESC) AS rn
 FROM score_log) WHERE rn = 1)"""


@query("A6, A1", """
SELECT c.campaign_id, s.pos AS position, s.stage, count(t.target_id) AS targets FROM campaigns c
CROSS JOIN (VALUES (0, 'In discovery'), (1, 'Qualified'), (2, 'Ready'), (3, 'Submitted'), (4, 'Responded'), (5, 'Placed'), (6, 'Closed')) s(pos, stage)
LEFT JOIN (SELECT target_id, campaign_id, CASE WHEN status = 'DISCOVERED' THEN 0 WHEN status = 'QUALIFIED' THEN 1
  WHEN status IN ('READY', 'DRAFTED', 'APPROVED') THEN 2 WHEN status IN ('SENT', 'DELIVERED') THEN 3
  WHEN status IN ('RESPONDED', 'FOLLOW_UP_DUE', 'ACCEPTED') THEN 4 WHEN status = 'PLACED' THEN 5 ELSE 6 END AS pos FROM targets) t
 ON t.campaign_id = c.campaign_id AND t.pos = s.pos GROUP BY 1, 2, 3
""", "campaigns targets")
def stage_rollup(spark, root):
    return reporting.stage_counts(bound(spark, root, "targets"), bound(spark, root, "campaigns"))


@query("A1, F2", "SELECT status, count(*) AS targets FROM targets WHERE status NOT IN ('DUPLICATE', 'BLOCKED') GROUP BY 1", "targets")
def status_counts(spark, root):
    return (bound(spark, root, "targets").filter(~F.col("status").isin("DUPLICATE", "BLOCKED"))
            .groupBy("status").agg(F.count("*").alias("targets")))


METRICS_SQL = f"""
WITH {NEWEST_SCORE},
line AS (SELECT target_id, count(*) FILTER (flag = 'A') AS sub, count(*) FILTER (flag = 'R') AS resp FROM score_log GROUP BY 1),
ver AS (SELECT DISTINCT target_id FROM score_log WHERE line = 'F' AND risk_score <= 20),
m AS (SELECT c.campaign_id, count(t.target_id) AS discovered, count(*) FILTER (n.score >= 70) AS high_fit, count(v.target_id) AS verified,
 count(*) FILTER (t.status IN ('READY', 'DRAFTED', 'APPROVED')) AS ready, count(*) FILTER (t.status = 'QUALIFIED') AS qualified,
 count(*) FILTER (t.status = 'DUPLICATE') AS duplicates, count(*) FILTER (t.status = 'DRAFTED') AS drafted,
 CAST(coalesce(sum(l.sub), 0) AS BIGINT) AS submitted, CAST(coalesce(sum(l.resp), 0) AS BIGINT) AS responses,
 count(*) FILTER (t.cost > 450000) AS placed
 FROM campaigns c LEFT JOIN targets t ON t.campaign_id = c.campaign_id LEFT JOIN newest n ON n.target_id = t.target_id
 LEFT JOIN line l ON l.target_id = t.target_id LEFT JOIN ver v ON v.target_id = t.target_id GROUP BY 1)
"""


def metrics_frame(spark, root):
    log = bound(spark, root, "score_log")
    targets = bound(spark, root, "targets")
    verified = log.filter("line = 'F' AND risk_score <= 20").select("target_id")
    sent = log.filter("flag = 'A'").select("target_id", F.col("created_at").alias("sent_at"))
    back = log.filter("flag = 'R'").select("target_id")
    placed = targets.filter("cost > 450000").select("campaign_id", F.lit(None).cast("date").alias("removed_date"))
    return reporting.campaign_metrics(bound(spark, root, "campaigns"), targets,
                                      log.select("target_id", "score", "created_at", "seq"), verified, sent, back, placed)


@query("A7, A8, A2, A5", METRICS_SQL + """
SELECT campaign_id, discovered, high_fit, verified, ready, qualified, duplicates, submitted, responses, placed,
 CASE WHEN submitted > 0 THEN CAST(round_even(responses / submitted * 100, 0) AS BIGINT) END AS response_rate,
 CASE WHEN submitted > 0 THEN CAST(round_even(placed / submitted * 100, 0) AS BIGINT) END AS placement_rate,
 CASE WHEN responses > 0 OR placed > 0 THEN 'Results' WHEN submitted > 0 THEN 'Outreach' WHEN drafted > 0 THEN 'Review'
  WHEN discovered > 0 THEN 'Opportunities' ELSE 'Setup' END AS stage FROM m
""", "campaigns targets score_log")
def campaign_metrics(spark, root):
    rows = metrics_frame(spark, root).withColumn("searches_used", F.lit(0)).withColumn("stage", reporting.campaign_stage())
    return rows.select("campaign_id", "discovered", "high_fit", "verified", "ready", "qualified", "duplicates", "submitted",
                       "responses", "placed", "response_rate", "placement_rate", "stage")


@query("A11", METRICS_SQL + """, f AS (SELECT campaign_id,
 CASE WHEN discovered > 0 THEN least(1.0, (qualified + ready) / discovered) ELSE 0 END AS y,
 CASE WHEN discovered > 0 THEN greatest(0.0, 1.0 - duplicates / discovered * 2) ELSE 1.0 END AS d,
 CASE WHEN discovered > 0 THEN least(1.0, verified / discovered * 2) ELSE 0 END AS v,
 CASE WHEN submitted > 0 THEN greatest(0.0, 1.0 - responses / submitted) ELSE 1.0 END AS j FROM m)
SELECT campaign_id, CAST(round_even((y * 0.3::DOUBLE + d * 0.2::DOUBLE + v * 0.3::DOUBLE + j * 0.2::DOUBLE) * 100, 0) AS BIGINT) AS health FROM f
""", "campaigns targets score_log")
def campaign_health(spark, root):
    m = metrics_frame(spark, root)
    progress = m.select("campaign_id", F.col("responses").alias("failed"), F.col("submitted").alias("total"))
    return reporting.campaign_health(m, progress).select("campaign_id", "health")


@query("A26", """
SELECT campaign_id, count(*) AS total, CASE WHEN count(*) >= 10 AND count(*) FILTER (cost > 300000) >= 10 THEN 'Search budget reached (' || count(*) FILTER (cost > 300000) || '/10)'
 WHEN count(*) >= 20 AND count(*) FILTER (status = 'DUPLICATE') / count(*) > 0.6 THEN 'dup'
 WHEN count(*) >= 20 AND count(*) FILTER (status IN ('QUALIFIED', 'READY')) / count(*) < 0.05 THEN
  'Qualified yield ' || CAST(round_even(count(*) FILTER (status IN ('QUALIFIED', 'READY')) / count(*) * 100, 0) AS BIGINT) || '% — diminishing returns' END AS stop_reason
FROM targets GROUP BY 1
""", "targets")
def stop_reasons(spark, root):
    counts = bound(spark, root, "targets").groupBy("campaign_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "DUPLICATE").alias("duplicates"),
        F.count_if(F.col("status").isin("QUALIFIED", "READY")).alias("qualified"), F.count_if(F.col("cost") > 300000).alias("searches_used"))
    counts = counts.withColumns({"search_budget": F.lit(10).cast("bigint"), "campaign_status": F.lit("ACTIVE")})
    return reporting.stop_reason(counts).select("campaign_id", "total", "stop_reason")


@query("J3, J1, R2", f"""
WITH {NEWEST_SCORE} SELECT t.target_id, t.campaign_id, t.status, n.score, n.risk_score, n.decision
FROM targets t LEFT JOIN newest n ON n.target_id = t.target_id
""", "targets score_log")
def targets_with_newest_results(spark, root):
    log = bound(spark, root, "score_log").withColumn("risk_band", sc.risk_band("risk_score"))
    targets = bound(spark, root, "targets").withColumn("outlet_id", F.lit(None).cast("bigint"))
    rows = reporting.target_list(targets, bound(spark, root, "outlets"), log, log, log)
    return rows.select("target_id", "campaign_id", "status", "score", "risk_score", "decision")


@query("F4, O1, F2", f"""
WITH {NEWEST_SCORE} SELECT t.target_id, t.status, n.score FROM targets t LEFT JOIN newest n ON n.target_id = t.target_id
WHERE t.status IN ('QUALIFIED', 'READY', 'DRAFTED') ORDER BY n.score DESC NULLS LAST, t.created_at DESC, t.target_id
""", "targets score_log")
def actionable_opportunities(spark, root):
    newest = latest.newest_per_key(bound(spark, root, "score_log"), ["target_id"], ["created_at", "seq"], ["score"])
    rows = bound(spark, root, "targets").filter(reporting.view_filter("actionable")).join(newest, "target_id", "left")
    return (rows.orderBy(F.col("score").desc_nulls_last(), F.col("created_at").desc(), "target_id")
            .select("target_id", "status", "score"))


@query("A13, K2", """
WITH s AS (SELECT DISTINCT target_id, CASE WHEN score >= 96 THEN 'guaranteed_streams' WHEN score >= 80 THEN 'injection_attempt'
  WHEN score >= 60 THEN 'unclear_ownership' WHEN score >= 40 THEN 'stale_presence' ELSE 'missing_submission_terms' END AS sig FROM score_log),
w AS (SELECT target_id, least(100, sum(CASE sig WHEN 'guaranteed_streams' THEN 60 WHEN 'injection_attempt' THEN 35 WHEN 'unclear_ownership' THEN 12
  WHEN 'stale_presence' THEN 10 ELSE 8 END))::BIGINT AS risk FROM s GROUP BY 1)
SELECT target_id, risk, CASE WHEN risk >= 75 THEN 'BLOCK' WHEN risk >= 50 THEN 'HIGH RISK' WHEN risk >= 21 THEN 'REVIEW' ELSE 'LOW RISK' END AS band FROM w
""", "score_log")
def risk_from_signals(spark, root):
    s = F.col("score")
    signal = (F.when(s >= 96, "guaranteed_streams").when(s >= 80, "injection_attempt").when(s >= 60, "unclear_ownership")
              .when(s >= 40, "stale_presence").otherwise("missing_submission_terms"))
    rows = bound(spark, root, "score_log").groupBy("target_id").agg(F.collect_set(signal).alias("signals"))
    return rows.select("target_id", sc.risk_score("signals").alias("risk"), sc.risk_band(sc.risk_score("signals")).alias("band"))


@query("A15, R3", """
SELECT target_id, CASE max(CASE decision WHEN 'ALLOW' THEN 0 WHEN 'APPROVAL_REQUIRED' THEN 1 WHEN 'DRAFT_ONLY' THEN 2 WHEN 'LEGAL_REVIEW' THEN 3 ELSE 4 END)
 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'APPROVAL_REQUIRED' WHEN 2 THEN 'DRAFT_ONLY' WHEN 3 THEN 'LEGAL_REVIEW' ELSE 'BLOCK' END AS decision
FROM score_log GROUP BY 1
""", "score_log")
def worst_decision(spark, root):
    return folds.severity_fold(bound(spark, root, "score_log"), ["target_id"], "decision", rules.DECISION_SEVERITY, "decision")


PART_SQL = """WITH p AS (SELECT service_id, CASE WHEN size > 10 THEN size / 50.0::DOUBLE END AS a, CASE WHEN kind = 'PROMO' THEN NULL WHEN kind = 'LARGE' THEN 1.0 ELSE 0.4 END AS b,
 CASE WHEN size % 3 = 0 THEN NULL ELSE 0.5 END AS c FROM services)"""


def part_components(spark, root):
    size = F.col("size")
    return bound(spark, root, "services").select(
        "service_id", F.when(size > 10, size / 50.0).alias("a"),
        F.when(F.col("kind") == "PROMO", F.lit(None)).when(F.col("kind") == "LARGE", 1.0).otherwise(0.4).alias("b"),
        F.when(size % 3 == 0, F.lit(None)).otherwise(0.5).alias("c"))


@query("A9, A10, R1", PART_SQL + """, w AS (SELECT *,
 (CASE WHEN a IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.3::DOUBLE END) + CASE WHEN c IS NULL THEN 0 ELSE 0.2::DOUBLE END AS kw,
 (coalesce(a * 0.5::DOUBLE, 0) + coalesce(b * 0.3::DOUBLE, 0)) + coalesce(c * 0.2::DOUBLE, 0) AS num FROM p)
SELECT service_id, coalesce(CASE WHEN kw > 0 THEN CAST(round_even(num / kw * 100, 0) AS BIGINT) END, 0) AS open_score,
 CASE WHEN kw >= 0.5 AND (a IS NOT NULL OR b IS NOT NULL) THEN CAST(round_even(num / kw * 100, 0) AS BIGINT) END AS guarded_score FROM w
""", "services")
def scores_with_unknown(spark, root):
    parts = [("a", 0.5), ("b", 0.3), ("c", 0.2)]
    return part_components(spark, root).select(
        "service_id", sc.weighted_score(parts, empty=0).alias("open_score"), sc.covered_score(parts, [2]).alias("guarded_score"))


@query("M1, D4, H32, O7", """
WITH x AS (SELECT outlet_id, CASE WHEN follower_count IS NULL THEN NULL WHEN follower_count >= 100000 THEN 0.9 WHEN follower_count >= 10000 THEN 0.8
 WHEN follower_count >= 1000 THEN 0.7 ELSE 0.5 END::DOUBLE AS audience, CASE WHEN tenant_id % 4 = 0 THEN NULL WHEN tenant_id <= 7 THEN 1.0 WHEN tenant_id <= 30 THEN 0.8 END::DOUBLE AS fresh,
 CASE WHEN tenant_id % 5 = 0 THEN NULL ELSE CASE WHEN tenant_id * 10 <= 14 THEN 1.0 WHEN tenant_id * 10 <= 45 THEN 0.8 WHEN tenant_id * 10 <= 120 THEN 0.5
   WHEN tenant_id * 10 <= 365 THEN 0.25 ELSE 0.0 END END::DOUBLE AS active FROM outlets)
SELECT outlet_id, audience, fresh, active, CASE WHEN active IS NULL THEN '?' WHEN active >= 0.75 THEN '+' WHEN active <= 0.25 THEN '-' END AS activity_sign FROM x
""", "outlets")
def component_steps(spark, root):
    from wayfold.functions.when import activity_fit, freshness_fit
    t = F.col("tenant_id")
    rows = bound(spark, root, "outlets").select(
        "outlet_id", sc.audience_fit("follower_count", F.lit("page")).alias("audience"),
        freshness_fit(F.when(t % 4 != 0, t)).alias("fresh"), activity_fit(F.when(t % 5 != 0, t * 10)).alias("active"))
    sign = F.when(F.col("active").isNull(), "?").when(F.col("active") >= 0.75, "+").when(F.col("active") <= 0.25, "-")
    return rows.withColumn("activity_sign", sign)


@query("A20, J2", """
WITH i AS (SELECT campaign_id, CASE WHEN cost % 7 < 1 THEN NULL ELSE cost END AS amount, status IN ('SENT', 'DELIVERED', 'BOUNCED') AS paid,
 CASE WHEN status = 'BOUNCED' THEN 'REFUNDED' WHEN status IN ('READY', 'DRAFTED', 'QUALIFIED') THEN 'PLANNED' ELSE 'DECLINED' END AS st FROM targets)
SELECT c.campaign_id, round(coalesce(sum(amount) FILTER (paid AND st <> 'REFUNDED'), 0), 2) AS spent,
 round(coalesce(sum(amount) FILTER (NOT paid AND st = 'PLANNED'), 0), 2) AS planned,
 count(*) FILTER (i.campaign_id IS NOT NULL AND amount IS NULL) AS unknown_amounts, count(i.campaign_id) AS items,
 round(c.promotion_budget - (coalesce(sum(amount) FILTER (paid AND st <> 'REFUNDED'), 0) + coalesce(sum(amount) FILTER (NOT paid AND st = 'PLANNED'), 0)), 2) AS remaining
FROM campaigns c LEFT JOIN i ON i.campaign_id = c.campaign_id GROUP BY c.campaign_id, c.promotion_budget
""", "campaigns targets")
def plan_totals(spark, root):
    totals = promotion.plan_totals(plan_items(spark, root), bound(spark, root, "campaigns"))
    return totals.select("campaign_id", F.round("spent", 2).alias("spent"), F.round("planned", 2).alias("planned"), "unknown_amounts",
                         "items", F.round("remaining", 2).alias("remaining"))


def plan_items(spark, root):
    paid = F.col("status").isin("SENT", "DELIVERED", "BOUNCED")
    return bound(spark, root, "targets").select(
        "campaign_id", F.when(F.col("cost") % 7 >= 1, F.col("cost")).alias("amount"), F.when(paid, F.col("created_at")).alias("paid_at"),
        F.when(F.col("status") == "BOUNCED", "REFUNDED").when(F.col("status").isin("READY", "DRAFTED", "QUALIFIED"), "PLANNED")
        .otherwise("DECLINED").alias("status"))


TYPE_SQL = "CASE kind WHEN 'PROMO' THEN 'PRESS_PR' WHEN 'LARGE' THEN 'ADVERTISING' WHEN 'SMALL' THEN 'CLUB' WHEN 'MEDIUM' THEN 'CURATOR_SUBMISSIONS' WHEN 'ECONOMY' THEN 'OTHER' END"
TYPES = {"PROMO": "PRESS_PR", "LARGE": "ADVERTISING", "SMALL": "CLUB", "MEDIUM": "CURATOR_SUBMISSIONS", "ECONOMY": "OTHER"}


@query("A28", f"""
WITH i AS (SELECT campaign_id, CASE WHEN cost % 7 < 1 THEN NULL ELSE cost END AS amount, status IN ('SENT', 'DELIVERED', 'BOUNCED') AS paid,
 CASE WHEN status = 'BOUNCED' THEN 'REFUNDED' WHEN status IN ('READY', 'DRAFTED', 'QUALIFIED') THEN 'PLANNED' ELSE 'DECLINED' END AS st FROM targets),
t AS (SELECT c.campaign_id, c.promotion_budget - coalesce(sum(amount) FILTER (st <> 'REFUNDED' AND (paid OR st = 'PLANNED')), 0) AS remaining
 FROM campaigns c LEFT JOIN i ON i.campaign_id = c.campaign_id GROUP BY c.campaign_id, c.promotion_budget),
q AS (SELECT DISTINCT t.campaign_id, CASE {TYPE_SQL} WHEN 'PRESS_PR' THEN 'PRESS_PR' WHEN 'ADVERTISING' THEN 'DIGITAL_ADVERTISING' WHEN 'CLUB' THEN 'DJ_CLUB'
  WHEN 'CURATOR_SUBMISSIONS' THEN 'CURATOR_SUBMISSIONS' ELSE 'OTHER' END AS category
 FROM score_log l JOIN targets t ON t.target_id = l.target_id JOIN services s ON s.service_id = l.service_id WHERE s.screening_status = 'SCREENED')
SELECT campaign_id, category, n AS categories, c // n + CASE WHEN 2 * (c % n) > n OR (2 * (c % n) = n AND (c // n) % 2 = 1) THEN 1 ELSE 0 END AS amount_cents
FROM (SELECT q.campaign_id, q.category, count(*) OVER (PARTITION BY q.campaign_id) AS n, CAST(round(t.remaining * 100) AS BIGINT) AS c
 FROM q JOIN t ON t.campaign_id = q.campaign_id WHERE t.remaining > 0)
""", "campaigns targets score_log services")
def suggested_allocation(spark, root):
    totals = promotion.plan_totals(plan_items(spark, root), bound(spark, root, "campaigns"))
    fine = bound(spark, root, "services").filter("screening_status = 'SCREENED'").select(
        "service_id", F.array_compact(F.array(tx.lookup("kind", TYPES))).alias("service_types"))
    used = (bound(spark, root, "score_log").select("target_id", "service_id")
            .join(bound(spark, root, "targets").select("target_id", "campaign_id"), "target_id").select("campaign_id", "service_id"))
    out = promotion.suggested_allocation(totals, used.join(fine, "service_id"))
    return out.select("campaign_id", "category", "categories", F.round(F.col("amount") * 100).cast("bigint").alias("amount_cents"))


FIT_SQL = f"""
WITH pairs AS (SELECT DISTINCT t.campaign_id, l.service_id FROM score_log l JOIN targets t ON t.target_id = l.target_id),
x AS (SELECT p.campaign_id, p.service_id, CASE c.segment WHEN 'BUILDING' THEN 'PLAYLIST' WHEN 'AUTOMOBILE' THEN 'BLOG' WHEN 'MACHINERY' THEN 'DJ' END AS channel,
 CASE {TYPE_SQL} WHEN 'PRESS_PR' THEN 'BLOG' WHEN 'CLUB' THEN 'DJ' WHEN 'CURATOR_SUBMISSIONS' THEN 'PLAYLIST' ELSE {TYPE_SQL} END AS offered,
 s.pricing_min, c.promotion_budget FROM pairs p JOIN campaigns c ON c.campaign_id = p.campaign_id JOIN services s ON s.service_id = p.service_id
 WHERE s.screening_status <> 'BLOCKED'),
y AS (SELECT *, CASE WHEN channel IS NULL OR offered IS NULL THEN NULL WHEN channel = offered THEN 1.0 WHEN contains(lower(channel), lower(offered)) OR contains(lower(offered), lower(channel)) THEN 0.5 ELSE 0.0 END AS ch,
 CASE WHEN pricing_min IS NULL OR promotion_budget IS NULL THEN NULL WHEN pricing_min <= promotion_budget THEN 1.0 ELSE 0.0 END AS bf FROM x)
SELECT campaign_id, service_id, CASE WHEN ch IS NULL AND bf IS NULL THEN NULL ELSE CAST(round_even(
 (coalesce(ch * 0.2::DOUBLE, 0) + coalesce(bf * 0.15::DOUBLE, 0)) / (CASE WHEN ch IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN bf IS NULL THEN 0 ELSE 0.15::DOUBLE END) * 100, 0) AS BIGINT) END AS fit_score FROM y
"""


@query("K10, H14, M3, J17", FIT_SQL, "campaigns targets score_log services")
def campaign_fit(spark, root):
    return fits(spark, root).select("campaign_id", "service_id", "fit_score")


def pair_parts(spark, root):
    """Parts for the pairs of the score log, by its number of rows, which Spark reads off the files' footers."""
    return parts_for(spark, bound(spark, root, "score_log").count())


def fits(spark, root):
    # nearly all pairs differ, so a fold before the shuffle would only hold them all in memory
    pairs = (bound(spark, root, "score_log").select("target_id", "service_id")
             .join(bound(spark, root, "targets").select("target_id", "campaign_id"), "target_id")
             .select("campaign_id", "service_id").repartition(pair_parts(spark, root), "campaign_id", "service_id").distinct())
    none = F.array().cast("array<string>")
    channels = {"BUILDING": "PLAYLIST", "AUTOMOBILE": "BLOG", "MACHINERY": "DJ"}
    campaigns = bound(spark, root, "campaigns").select("campaign_id", "promotion_budget", F.array_compact(
        F.array(tx.lookup("segment", channels))).alias("channels"))
    services = bound(spark, root, "services").filter("screening_status <> 'BLOCKED'").select(
        "service_id", "name", "screening_status", "pricing_min", F.array_compact(F.array(tx.lookup("kind", TYPES))).alias("service_types"))
    rows = pairs.join(campaigns, "campaign_id").join(services, "service_id").withColumns({
        "primary_genre": F.lit(None).cast("string"), "secondary_genres": none, "microgenres": none, "supported_genres": none,
        "territories": none, "supported_territories": none, "language": F.lit(None).cast("string"), "supported_languages": none,
        "priorities": none})
    return promotion.campaign_fit(rows)


@query("K11, F3, O4", f"""
SELECT service_id, screening_status, CASE screening_status WHEN 'SCREENED' THEN 0 WHEN 'CAUTION' THEN 1 WHEN 'UNKNOWN' THEN 2 ELSE 3 END AS list_group
FROM services WHERE {TYPE_SQL} = 'PRESS_PR' AND pricing_min IS NOT NULL AND pricing_min <= 950
""", "services")
def filtered_services(spark, root):
    rows = bound(spark, root, "services").withColumn("service_types", F.array_compact(F.array(tx.lookup("kind", TYPES))))
    kept = rows.filter(promotion.service_filter("all", channel="BLOG", price_max=950.0))
    group = tx.lookup("screening_status", rules.SCREENING_LIST_ORDER)
    return kept.select("service_id", "screening_status", group.alias("list_group"))


@query("K11, W1, O4", f"""
WITH fit AS ({{FIT}}) SELECT fit.campaign_id, fit.service_id, s.name, s.screening_status, fit.fit_score, TRUE AS stale, s.pricing_min IS NOT NULL AS pricing_current
FROM fit JOIN services s ON s.service_id = fit.service_id
""".replace("{FIT}", FIT_SQL), "campaigns targets score_log services")
def campaign_service_list(spark, root):
    log = fits(spark, root).withColumns({"created_at": moment(TRADE_AS_OF), "seq": F.lit(0)})
    pairs = log.select("campaign_id", "service_id", "name", "screening_status", "pricing_min", "service_types").withColumns({
        "next_review_at": F.lit(None).cast("timestamp"), "last_screened_at": F.lit(None).cast("timestamp"),
        "pricing_last_verified_at": moment(TRADE_AS_OF)})
    return promotion.campaign_services(pairs, log, "all", TRADE_AS_OF, pair_parts(spark, root)).select(
        "campaign_id", "service_id", "name", "screening_status", "fit_score", "stale", "pricing_current")


@query("J12", """
WITH used AS (SELECT DISTINCT l.service_id, c.segment FROM score_log l JOIN targets t ON t.target_id = l.target_id JOIN campaigns c ON c.campaign_id = t.campaign_id
 WHERE c.status NOT IN ('COMPLETED', 'CANCELLED') AND t.status NOT IN ('DUPLICATE', 'DISQUALIFIED', 'BLOCKED')),
n AS (SELECT service_id FROM used GROUP BY 1 HAVING count(*) > 1)
SELECT u.segment, s.service_id, s.name FROM used u JOIN n ON n.service_id = u.service_id JOIN services s ON s.service_id = u.service_id
""", "campaigns targets score_log services")
def shared_services(spark, root):
    live = (bound(spark, root, "score_log").select("target_id", "service_id")
            .join(bound(spark, root, "targets").filter(~F.col("status").isin(rules.NOT_LIVE_TARGETS)).select("target_id", "campaign_id"), "target_id")
            .join(bound(spark, root, "campaigns").filter(~F.col("status").isin(rules.CLOSED_CAMPAIGNS)).select("campaign_id", "segment"), "campaign_id"))
    shared = joins.shared_members(live.withColumn("member", F.col("service_id")), "member", "segment", "service_id")
    return shared.join(bound(spark, root, "services").select("service_id", "name"), "service_id").select("segment", "service_id", "name")


@query("J8", """
SELECT campaign_id, CASE WHEN campaign_id IN (SELECT target_id FROM targets WHERE status = 'SENT')
 OR name IN (SELECT 'Customer#' || lpad(CAST(campaign_id AS VARCHAR), 9, '0') FROM targets WHERE status = 'BOUNCED') THEN 1.0::DOUBLE END AS peer_coverage FROM campaigns
""", "campaigns targets")
def or_key_coverage(spark, root):
    t = bound(spark, root, "targets")
    right = t.filter("status = 'SENT'").select(F.col("target_id").alias("k1"), F.lit(None).cast("string").alias("k2")).unionByName(
        t.filter("status = 'BOUNCED'").select(F.lit(None).cast("bigint").alias("k1"), F.format_string("Customer#%09d", "campaign_id").alias("k2")))
    left = bound(spark, root, "campaigns").select("campaign_id", "name", F.col("campaign_id").alias("k"))
    return joins.or_key_flag(left, right, [("k", "k1"), ("name", "k2")], "campaign_id", [], "peer_coverage").select("campaign_id", "peer_coverage")


@query("J5", "SELECT campaign_id, name FROM campaigns WHERE campaign_id IN (SELECT campaign_id FROM targets WHERE cost > 400000)", "campaigns targets")
def campaigns_with_large_target(spark, root):
    big = bound(spark, root, "targets").filter("cost > 400000").select("campaign_id")
    return bound(spark, root, "campaigns").select("campaign_id", "name").join(big, "campaign_id", "left_semi")


@query("J6", "SELECT campaign_id, name FROM campaigns WHERE campaign_id NOT IN (SELECT campaign_id FROM targets)", "campaigns targets")
def campaigns_without_target(spark, root):
    return bound(spark, root, "campaigns").select("campaign_id", "name").join(
        bound(spark, root, "targets").select("campaign_id"), "campaign_id", "left_anti")


@query("J4", """
SELECT c.campaign_id, count(t.target_id) AS targets, count(*) FILTER (t.status = 'ACCEPTED') AS accepted, count(*) FILTER (t.status = 'OPTED_OUT') AS opted_out
FROM campaigns c LEFT JOIN targets t ON t.campaign_id = c.campaign_id GROUP BY 1
""", "campaigns targets")
def counts_per_campaign(spark, root):
    sums = bound(spark, root, "targets").groupBy("campaign_id").agg(
        F.count("*").alias("targets"), F.count_if(F.col("status") == "ACCEPTED").alias("accepted"),
        F.count_if(F.col("status") == "OPTED_OUT").alias("opted_out"))
    return bound(spark, root, "campaigns").select("campaign_id").join(sums, "campaign_id", "left").fillna(0)


@query("J7, C3, C4", """
WITH reg AS (SELECT sha256(name) AS h, CASE WHEN segment = 'BUILDING' THEN 'GLOBAL' ELSE 'TENANT' END AS scope, tenant_id, segment FROM campaigns WHERE promotion_budget IS NULL),
m AS (SELECT c.campaign_id, sha256(c.name) AS h, (c.tenant_id // 2) * 2 AS tenant_id, c.segment FROM campaigns c),
j AS (SELECT m.*, (SELECT min(segment) FROM reg r WHERE r.h = m.h AND r.scope = 'GLOBAL') AS g,
 (SELECT min(segment) FROM reg r WHERE r.h = m.h AND r.scope = 'TENANT' AND r.tenant_id = m.tenant_id) AS t FROM m)
SELECT campaign_id, coalesce(g, t) AS suppression_reason, coalesce(g, t) IS NULL AND segment <> 'FURNITURE' AND segment <> 'MACHINERY' AS sendable FROM j
""", "campaigns")
def sendable_addresses(spark, root):
    c = bound(spark, root, "campaigns").withColumn("value_hash", F.sha2(F.encode("name", "utf-8"), 256))
    register = c.filter("promotion_budget IS NULL").select(
        "value_hash", F.when(F.col("segment") == "BUILDING", "GLOBAL").otherwise("TENANT").alias("scope"), "tenant_id",
        F.col("segment").alias("reason"))
    kinds = {"FURNITURE": "PERSONAL_ADDRESS", "MACHINERY": "UNVERIFIED_PUBLIC_BUSINESS"}
    methods = c.select("campaign_id", "value_hash", (F.floor(F.col("tenant_id") / 2) * 2).cast("bigint").alias("tenant_id"), F.lit("EMAIL").alias("kind"),
                       F.coalesce(tx.lookup("segment", kinds), F.lit("ROLE_BASED_ADDRESS")).alias("category"),
                       F.lit(False).alias("restricted_only"), F.lit(1).alias("independent_domains"))
    return contacts.sendability(methods, register).select("campaign_id", "suppression_reason", "sendable")


@query("J9", """
WITH a AS (SELECT campaign_id, CASE WHEN segment <> 'BUILDING' THEN segment END AS contact FROM campaigns),
b AS (SELECT CASE WHEN segment <> 'BUILDING' THEN segment END AS contact, count(*) AS n FROM campaigns WHERE tenant_id < 10 GROUP BY 1)
SELECT a.campaign_id, a.contact, b.n FROM a LEFT JOIN b ON a.contact IS NOT DISTINCT FROM b.contact
""", "campaigns")
def null_safe_lookup(spark, root):
    c = bound(spark, root, "campaigns").withColumn("contact", F.when(F.col("segment") != "BUILDING", F.col("segment")))
    n = c.filter("tenant_id < 10").groupBy("contact").agg(F.count("*").alias("n"))
    return joins.null_safe_join(c.select("campaign_id", "contact"), n, ["contact"])


@query("J1, E8", """
SELECT t.target_id, c.name, n.n_name AS country FROM targets t JOIN campaigns c ON c.campaign_id = t.campaign_id JOIN nation n ON n.n_nationkey = c.tenant_id
""", "campaigns targets")
def targets_with_dimensions(spark, root):
    nation = spark.read.parquet(f"{root}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("tenant_id"), F.col("n_name").alias("country"))
    c = bound(spark, root, "campaigns").select("campaign_id", "tenant_id", "name").join(nation, "tenant_id")
    return bound(spark, root, "targets").select("target_id", "campaign_id").join(c, "campaign_id").select("target_id", "name", "country")


@query("E5, R4", """
WITH RECURSIVE edges AS (SELECT service_id AS loser, service_id // 2 AS winner FROM services WHERE service_id % 2 = 0 AND service_id > 0
  UNION ALL SELECT 0, 0 FROM services WHERE FALSE),
walk AS (SELECT loser, winner FROM edges UNION ALL SELECT w.loser, e.winner FROM walk w JOIN edges e ON e.loser = w.winner)
SELECT loser, min(winner) AS root FROM walk GROUP BY 1
""", "services")
def merge_roots(spark, root):
    s = bound(spark, root, "services").filter("service_id % 2 = 0 AND service_id > 0")
    edges = s.select(F.col("service_id").alias("loser"), F.floor(F.col("service_id") / 2).cast("bigint").alias("winner"))
    return graph.merge_roots(edges).select("loser", "root")


@query("E6", """
WITH r AS (SELECT DISTINCT brand, size, service_id FROM services)
SELECT r.brand AS destination, w.winner_id, r.service_id AS loser_id FROM r
JOIN (SELECT brand, size, min(service_id) AS winner_id FROM r GROUP BY 1, 2) w ON w.brand = r.brand AND w.size = r.size WHERE r.service_id <> w.winner_id
""", "services")
def exact_route_merges(spark, root):
    s = bound(spark, root, "services")
    outlets = s.select(F.lit(1).alias("tenant_id"), F.col("service_id").alias("outlet_id"), F.format_string("s%d.example", "size").alias("domain"),
                       F.lit(None).cast("bigint").alias("canonical_id"))
    routes = s.select(F.lit(1).alias("tenant_id"), F.col("service_id").alias("outlet_id"), F.lit("EMAIL").alias("method"),
                      F.lit(True).alias("active"), F.col("brand").alias("destination"))
    return entities.route_merges(routes, outlets).select("destination", "winner_id", "loser_id")


@query("E7, H6", """
SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS name_key, service_id, count(*) OVER (PARTITION BY regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) AS candidates
FROM services QUALIFY candidates > 1
""", "services")
def merge_suggestions(spark, root):
    return entities.name_suggestions(bound(spark, root, "services"), [], "service_id", "name")


@query("S5, E1, S4", """
WITH ch AS (SELECT outlet_id, created_at, seq, target_id, CASE WHEN risk_score > 80 THEN 'OPEN' WHEN risk_score > 60 THEN 'CLOSED' ELSE 'UNKNOWN' END AS so,
  CASE WHEN score > 60 THEN score END AS fc, flag FROM score_log),
o AS (SELECT *, struct_pack(a := created_at, b := seq, c := target_id) AS k FROM ch)
SELECT b.outlet_id, coalesce((SELECT arg_max(so, k) FROM o WHERE o.outlet_id = b.outlet_id AND so <> 'UNKNOWN'), 'UNKNOWN') AS submissions_open,
 coalesce((SELECT arg_max(fc, k) FROM o WHERE o.outlet_id = b.outlet_id AND fc IS NOT NULL), b.follower_count) AS follower_count,
 CASE WHEN (SELECT count(*) FROM o WHERE o.outlet_id = b.outlet_id AND fc IS NOT NULL) > 0 THEN (SELECT arg_max(flag, k) FROM o WHERE o.outlet_id = b.outlet_id AND fc IS NOT NULL)
   WHEN b.follower_count IS NOT NULL THEN 'base' END AS follower_count_source,
 array_to_string(list_sort(list_distinct(['known'] || coalesce((SELECT list(flag) FROM o WHERE o.outlet_id = b.outlet_id), [])
  || coalesce((SELECT list('status ' || so) FROM o WHERE o.outlet_id = b.outlet_id), []))), ',') AS labels FROM outlets b
""", "outlets score_log")
def outlet_snapshot(spark, root):
    base = bound(spark, root, "outlets").select(
        F.lit(1).alias("tenant_id"), F.col("outlet_id").cast("string").alias("identity"), F.lit("UNKNOWN").alias("submissions_open"), "follower_count",
        F.lit("base").alias("follower_count_source"), F.array(F.lit("known")).alias("labels"))
    risk = F.col("risk_score")
    changes = bound(spark, root, "score_log").select(
        F.lit(1).alias("tenant_id"), F.col("outlet_id").cast("string").alias("identity"), "created_at", "seq", "target_id",
        F.when(risk > 80, "OPEN").when(risk > 60, "CLOSED").otherwise("UNKNOWN").alias("submissions_open"),
        F.when(F.col("score") > 60, F.col("score")).alias("follower_count"), F.col("flag").alias("follower_count_source"))
    changes = changes.withColumn("labels", F.array(F.col("follower_count_source"), F.concat(F.lit("status "), "submissions_open")))
    out = entities.upsert_outlets(base, changes, ["created_at", "seq", "target_id"], labels=Labels(["known", "status OPEN", "status CLOSED", "status UNKNOWN"]))
    return out.select(F.col("identity").cast("bigint").alias("outlet_id"), "submissions_open", "follower_count", "follower_count_source",
                      F.array_join("labels", ",").alias("labels"))


@query("S6", """
SELECT target_id FROM targets WHERE NOT (status IN ('SENT', 'READY') AND created_at + INTERVAL 365 DAY < TIMESTAMP '2001-09-01') AND status <> 'BOUNCED'
""", "targets")
def retention_purge(spark, root):
    docs = bound(spark, root, "targets").select(F.col("target_id").alias("id"), F.col("status").alias("provider"), "created_at")
    days = docs.select("provider").distinct().withColumn("retention_days", F.when(F.col("provider").isin("SENT", "READY"), 365))
    kept = upsert.drop_expired(docs, days, TRADE_AS_OF)
    evidence = docs.select(F.col("id").alias("source_document_id"), F.col("provider").alias("source_type"))
    left, _loose = upsert.forget_provider(kept, evidence, "BOUNCED")
    return left.select(F.col("id").alias("target_id"))


@query("A12", """
WITH o AS (SELECT target_id AS placement_id, CASE flag WHEN 'A' THEN 'saves' WHEN 'R' THEN 'follows' ELSE 'unique_listeners' END AS metric,
  arg_max(score * 10, struct_pack(a := created_at, b := seq)) AS v FROM score_log GROUP BY 1, 2),
w AS (SELECT t.target_id AS placement_id, max(v) FILTER (metric = 'unique_listeners') AS u, max(v) FILTER (metric = 'saves') AS s, max(v) FILTER (metric = 'follows') AS f,
  greatest(0, date_diff('day', CAST(t.created_at AS DATE), DATE '2001-09-01')) AS d, t.cost FROM targets t LEFT JOIN o ON o.placement_id = t.target_id GROUP BY t.target_id, t.created_at, t.cost),
n AS (SELECT *, (((CASE WHEN u IS NULL THEN 0 ELSE least(1.0, u / 1000) * 0.25::DOUBLE END + CASE WHEN s IS NULL THEN 0 ELSE least(1.0, s / 1000) * 0.2::DOUBLE END) + CASE WHEN f IS NULL THEN 0 ELSE least(1.0, f / 1000) * 0.15::DOUBLE END)
   + CASE WHEN d > 0 THEN least(1.0, d / 1000) * 0.15::DOUBLE ELSE 0 END) AS num,
  ((CASE WHEN u IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN s IS NULL THEN 0 ELSE 0.2::DOUBLE END) + CASE WHEN f IS NULL THEN 0 ELSE 0.15::DOUBLE END) + CASE WHEN d > 0 THEN 0.15::DOUBLE ELSE 0 END AS den FROM w)
SELECT placement_id, CASE WHEN den > 0 THEN CAST(round_even(num / den * 100, 0) AS BIGINT) END AS score, CASE WHEN den > 0 THEN 'MEASURED' ELSE 'UNMEASURED' END AS state FROM n
""", "targets score_log")
def placement_values(spark, root):
    placements = bound(spark, root, "targets").select(F.col("target_id").alias("placement_id"), F.to_date("created_at").alias("added_date"),
                                                      F.lit(None).cast("date").alias("removed_date"), "cost")
    kinds = {"A": "saves", "R": "follows", "N": "unique_listeners"}
    outcomes = bound(spark, root, "score_log").select(
        F.col("target_id").alias("placement_id"), tx.lookup("flag", kinds).alias("metric"), (F.col("score") * 10).cast("double").alias("value"),
        F.col("created_at").alias("captured_at"), "seq")
    return reporting.placement_value(placements, outcomes, TRADE_AS_OF).select("placement_id", "score", "state")


@query("O3, E2", """
SELECT outlet_id, method, seq FROM (SELECT outlet_id, seq, target_id, CASE flag WHEN 'A' THEN 'WEB_FORM' WHEN 'R' THEN 'LOGIN_REQUIRED' ELSE 'EMAIL' END AS method,
 row_number() OVER (PARTITION BY outlet_id ORDER BY CASE flag WHEN 'A' THEN 1 WHEN 'R' THEN 5 ELSE 0 END, CASE WHEN risk_score > 50 THEN 0 ELSE 1 END, created_at, seq, target_id) AS rn
 FROM score_log WHERE line = 'O') WHERE rn = 1
""", "score_log")
def best_route_per_outlet(spark, root):
    kinds = {"A": "WEB_FORM", "R": "LOGIN_REQUIRED", "N": "EMAIL"}
    routes = bound(spark, root, "score_log").select(
        "outlet_id", "seq", "created_at", "target_id", tx.lookup("flag", kinds).alias("method"), (F.col("line") == "O").alias("active"),
        F.when(F.col("risk_score") > 50, F.col("created_at")).alias("verified_at"))
    return latest.best_route(routes, ["outlet_id"], ["created_at", "seq", "target_id"]).select("outlet_id", "method", "seq")


@query("W13", """
SELECT outlet_id AS contact_id, seq, category FROM (SELECT outlet_id, seq, CASE flag WHEN 'A' THEN 'ROLE_BASED_ADDRESS' ELSE 'PERSONAL_ADDRESS' END AS category,
 row_number() OVER (PARTITION BY outlet_id ORDER BY CASE WHEN flag = 'A' THEN 0 ELSE 1 END, created_at, seq, target_id) AS rn FROM score_log) WHERE rn = 1
""", "score_log")
def preferred_method_per_contact(spark, root):
    rows = bound(spark, root, "score_log").select(
        F.col("outlet_id").alias("contact_id"), "seq", "created_at", "target_id",
        F.when(F.col("flag") == "A", "ROLE_BASED_ADDRESS").otherwise("PERSONAL_ADDRESS").alias("category"))
    return latest.preferred_method(rows, ["contact_id"], ["created_at", "seq", "target_id"]).select("contact_id", "seq", "category")


@query("A33", """
WITH m AS (SELECT campaign_id, date_trunc('month', created_at) AS mon, sum(cost) AS v FROM targets GROUP BY 1, 2),
e AS (SELECT campaign_id, count(*) AS points, arg_min(v, mon) AS f, arg_max(v, mon) AS l FROM m GROUP BY 1)
SELECT campaign_id, points, CASE WHEN points >= 2 AND f > 0 THEN CAST(round_even((l - f) / f * 100, 0) AS BIGINT) END AS growth FROM e
""", "targets")
def monthly_growth(spark, root):
    monthly = bound(spark, root, "targets").groupBy("campaign_id", F.date_trunc("month", "created_at").alias("mon")).agg(F.sum("cost").alias("v"))
    series = monthly.groupBy("campaign_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("mon", "v"))), lambda p: p["v"]).alias("series"))
    return series.select("campaign_id", F.size("series").cast("bigint").alias("points"), sc.growth_percent("series").alias("growth"))


@query("L5", "SELECT campaign_id, 'streams' AS metric, promotion_budget AS value FROM campaigns WHERE promotion_budget IS NOT NULL", "campaigns")
def baseline_snapshots(spark, root):
    c = bound(spark, root, "campaigns").select("campaign_id", F.col("campaign_id").alias("recording_id"), F.col("promotion_budget").alias("streams"))
    return reporting.baseline_snapshots(c.drop("streams"), c.select("recording_id", "streams"), TRADE_AS_OF).select("campaign_id", "metric", "value")


@query("A14", """
SELECT flag AS supports_field, target_id AS entity_id, count(DISTINCT outlet_id) AS corroborating_domains FROM score_log GROUP BY 1, 2
""", "score_log")
def corroboration_per_field(spark, root):
    from wayfold.plans.page_facts import corroboration
    rows = bound(spark, root, "score_log").select(F.lit("target").alias("entity_type"), F.col("target_id").alias("entity_id"),
                                                  F.col("flag").alias("supports_field"), F.col("outlet_id").cast("string").alias("source_domain"))
    return corroboration(rows).select("supports_field", "entity_id", "corroborating_domains")


@query("O5", "SELECT service_id, name FROM services ORDER BY lower(name), service_id", "services")
def services_by_name(spark, root):
    return bound(spark, root, "services").orderBy(F.lower("name"), "service_id").select("service_id", "name")


@query("O8", "SELECT target_id, epoch_us(created_at) AS at_us FROM targets ORDER BY created_at DESC, target_id DESC LIMIT 200", "targets")
def newest_targets(spark, root):
    rows = bound(spark, root, "targets").orderBy(F.col("created_at").desc(), F.col("target_id").desc()).limit(200)
    return rows.select("target_id", micros("created_at").alias("at_us"))


@query("U1", """
SELECT lower(trim(name)) AS folded, min(service_id) AS service_id FROM services GROUP BY 1
""", "services")
def ordered_distinct_names(spark, root):
    rows = bound(spark, root, "services").withColumn("all", F.lit(1))
    out = latest.ordered_distinct(rows.select("all", "name", "service_id"), ["all"], "name", ["service_id"])
    return out.select(F.lower(F.trim("name")).alias("folded"), "service_id")


@query("Q-checks", """
SELECT target_id, outlet_id, count(*) AS rows FROM score_log GROUP BY 1, 2 HAVING count(*) > 1
""", "score_log")
def duplicate_pairs(spark, root):
    return quality.duplicates(bound(spark, root, "score_log"), ["target_id", "outlet_id"])


@query("Q-checks, L4", "SELECT target_id, seq FROM score_log WHERE service_id NOT IN (SELECT service_id FROM services WHERE size > 2)", "score_log services")
def placements_without_evidence(spark, root):
    good = bound(spark, root, "services").filter("size > 2")
    return quality.orphans(bound(spark, root, "score_log").select("target_id", "seq", "service_id"), "service_id", good, "service_id").select("target_id", "seq")


@query("S3, K5, S2", "SELECT status, count(*) AS targets FROM targets GROUP BY 1", "targets")
def appended_log_by_status(spark, root):
    from wayfold.session import shared_folder
    from wayfold.sources.tables import append_log
    import uuid
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    append_log(bound(spark, root, "targets"), path, ["status"])
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("targets"))


@query("K3, K4, H29, H30", """
WITH x AS (SELECT l.target_id, l.seq, l.outlet_id, l.risk_score, l.score, CASE WHEN l.risk_score >= 75 THEN 4 WHEN l.risk_score >= 50 THEN 3 ELSE 1 END AS r,
 CASE l.flag WHEN 'A' THEN 'PAID_CONSIDERATION' WHEN 'R' THEN 'ADVERTISING_OR_SPONSORSHIP' ELSE 'FREE_SUBMISSION' END AS cost_model,
 CASE WHEN l.line = 'F' AND l.score > 80 THEN 'PERSONAL_ADDRESS' WHEN l.line = 'F' THEN 'ROLE_BASED_ADDRESS' END AS cat FROM score_log l),
s AS (SELECT *, greatest(1, CASE WHEN cat IS NULL THEN 2 WHEN cat = 'PERSONAL_ADDRESS' THEN 4 ELSE 0 END, r,
 CASE WHEN cost_model = 'ADVERTISING_OR_SPONSORSHIP' THEN 3 ELSE 0 END) AS sev FROM x)
SELECT target_id, seq, outlet_id, CASE sev WHEN 1 THEN 'APPROVAL_REQUIRED' WHEN 2 THEN 'DRAFT_ONLY' WHEN 3 THEN 'LEGAL_REVIEW' ELSE 'BLOCK' END AS decision,
 CASE WHEN cost_model = 'PAID_CONSIDERATION' THEN 'PAID_CONSIDERATION' WHEN cost_model = 'ADVERTISING_OR_SPONSORSHIP' THEN 'SPONSORSHIP_OR_ADVERTISING'
  WHEN cat = 'ROLE_BASED_ADDRESS' THEN 'COLD_PROFESSIONAL_OUTREACH' ELSE 'UNKNOWN' END AS outreach_category,
 CASE WHEN sev = 4 THEN 'BLOCKED' WHEN score < 35 THEN 'DISQUALIFIED' WHEN sev IN (2, 3) THEN 'QUALIFIED' ELSE 'READY' END AS status FROM s
""", "score_log")
def compliance_decisions(spark, root):
    line, flag = F.col("line"), F.col("flag")
    has = line == "F"
    rows = bound(spark, root, "score_log").drop("decision").withColumns({
        "has_method": has, "restricted_only": F.lit(False),
        "contact_category": F.when(has & (F.col("score") > 80), "PERSONAL_ADDRESS").when(has, "ROLE_BASED_ADDRESS"),
        "suppression_reason": F.lit(None).cast("string"), "sendable": F.lit(True), "blockers": F.array().cast("array<string>"),
        "risk_band": sc.risk_band("risk_score"),
        "cost_model": F.when(flag == "A", "PAID_CONSIDERATION").when(flag == "R", "ADVERTISING_OR_SPONSORSHIP").otherwise("FREE_SUBMISSION"),
        "accepted_count": F.lit(0), "placement_count": F.lit(0), "territory": F.lit("US"), "contact_domain": F.lit(None).cast("string"),
        "outlet_domain": F.lit(None).cast("string"), "sender_ready": F.lit(True), "mode": F.lit("COPILOT"), "send_stop": F.lit(False),
        "submissions_open": F.lit("OPEN"), "route_method": F.lit("EMAIL")})
    return scoring.qualify(scoring.decide(rows)).select("target_id", "seq", "outlet_id", "decision", "outreach_category", "status")
