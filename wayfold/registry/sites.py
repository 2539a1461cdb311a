"""Page queries: hosts, admission, budgets, page records, the discovery funnel."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import keys as ky
from wayfold.functions import web
from wayfold.operators import latest
from wayfold.plans import discovery, entities, page_facts, planning, promotion
from wayfold.plans.reporting import stop_reason
from wayfold.registry.base import AS_OF, bound, query
from wayfold.session import materialize, shared_folder
from wayfold.sources.pages import read_pages

HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
SITE = "array_to_string(string_split({h}, '.')[-2:], '.')"


def crawl(spark, root):
    return bound(spark, root, "crawl").select("page_id", "url").withColumn("host", web.host_of("url"))


@query("H3, H4, E4, A5, A26, W2", f"""
WITH p AS (SELECT page_id, {HOST} AS host FROM crawl)
SELECT host, {SITE.format(h='host')} AS site, min(page_id) AS owner_page, count(*) AS pages, count(*) - 1 AS duplicates,
 CAST(round_even((count(*) - 1) / count(*) * 100, 0) AS BIGINT) AS duplicate_pct,
 CASE WHEN count(*) >= 20 AND (count(*) - 1) / count(*) > 0.6 THEN 'Duplicate rate ' || CAST(round_even((count(*) - 1) / count(*) * 100, 0) AS BIGINT) || '% — diminishing returns' END AS stop_reason
FROM p GROUP BY 1, 2
""", "crawl")
def pages_per_host(spark, root):
    sums = crawl(spark, root).groupBy("host").agg(F.min("page_id").alias("owner_page"), F.count("*").alias("pages"))
    rows = sums.withColumns({"duplicates": F.col("pages") - 1, "total": F.col("pages"), "qualified": F.lit(1000), "site": web.registrable_domain("host"),
                             "search_budget": F.lit(1), "searches_used": F.lit(0), "campaign_status": F.lit("ACTIVE")})
    from wayfold.functions.score import percent
    return stop_reason(rows).select("host", "site", "owner_page", "pages", "duplicates",
                                    percent("duplicates", "pages").alias("duplicate_pct"), "stop_reason")


@query("E4, W2", f"""
SELECT page_id, min(page_id) OVER w AS owner_id, count(*) OVER w AS members, page_id <> min(page_id) OVER w AS is_duplicate
FROM (SELECT page_id, {HOST} AS host FROM crawl) WINDOW w AS (PARTITION BY host)
""", "crawl")
def page_owners(spark, root):
    return entities.owners(crawl(spark, root), ["host"], "page_id", ["page_id"]).select("page_id", "owner_id", "members", "is_duplicate")


@query("X5, X2, H3", f"""
WITH p AS (SELECT page_id, url, {HOST} AS host FROM crawl)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'contact:' || sha256(host) WHEN page_id % 3 = 1 THEN 'domain:' || {SITE.format(h='host')} ELSE 'outlet:' || page_id END AS dedup_key,
 sha256(lower(trim(url))) AS url_hash, sha256(lower(trim('trend|' || host || '|' || url))) AS event_key FROM p
""", "crawl")
def recipient_keys(spark, root):
    third = F.col("page_id") % 3
    return crawl(spark, root).select(
        "page_id", ky.recipient_key(F.when(third == 0, F.sha2(F.encode("host", "utf-8"), 256)), F.when(third == 1, F.col("host")), F.col("page_id")).alias("dedup_key"),
        ky.url_hash("url").alias("url_hash"), ky.coverage_key(F.lit(None), F.col("host"), F.col("url")).alias("event_key"))


VARIANTS = ["{u}", "ftp{r}", "{s}://localhost/{p}", "{s}://169.254.169.254/{p}", "{s}://10.1.2.3/{p}", "{s}://8.8.8.8/{p}", "{s}://x.internal/{p}",
            "{s}://a.example:9999/{p}", "{s}://a.example:8443/{p}", "{s}://a.example/{p}.zip", "{s}://a.example/f.exe?x={p}", "{s}://192.168.0.{p}/"]
WHY = [None, "BLOCKED_SCHEME", "BLOCKED_HOSTNAME", "BLOCKED_METADATA_ENDPOINT", "BLOCKED_PRIVATE_IP", None, "BLOCKED_HOSTNAME", "BLOCKED_PORT", None,
       "BLOCKED_FILE_TYPE", "BLOCKED_FILE_TYPE", "BLOCKED_PRIVATE_IP"]


def url_variants(spark, root):
    scheme, rest = F.regexp_extract("url", "^([a-z]+)", 1), F.regexp_extract("url", "^[a-z]+(.*)$", 1)
    page = (F.col("page_id") % 250).cast("string")

    def build(pattern: str):
        out = F.lit(pattern)
        for hole, value in (("{u}", F.col("url")), ("{r}", rest), ("{s}", scheme), ("{p}", page)):
            out = F.replace(out, F.lit(hole), value)
        return out
    return bound(spark, root, "crawl").select("page_id", F.posexplode(F.array(*[build(v) for v in VARIANTS])).alias("variant", "url"))


@query("F6", "SELECT page_id, v.variant, v.reason FROM crawl, (VALUES " + ", ".join(
    f"({i}, {repr(w) if w else 'NULL'})" for i, w in enumerate(WHY)) + ") v(variant, reason)", "crawl")
def url_admission(spark, root):
    return url_variants(spark, root).select("page_id", "variant", web.block_reason("url").alias("reason"))


@query("F7", """
SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'DISALLOWED_MIME_TYPE' WHEN length(html) > 5000 THEN 'RESPONSE_TOO_LARGE' END AS reason FROM crawl
""", "crawl")
def response_admission(spark, root):
    mime = F.when(F.col("page_id") % 4 == 0, "text/html; charset=utf-8").when(F.col("page_id") % 4 == 1, "image/png").when(F.col("page_id") % 4 == 2, "")
    return bound(spark, root, "crawl").select("page_id", web.response_block_reason(mime, F.length("html"), 5000).alias("reason"))


@query("F8, H3", """
SELECT page_id, page_id % 3 = 0 AS is_platform FROM crawl
""", "crawl")
def platform_hosts(spark, root):
    sites = F.array(F.lit("open.spotify.com"), F.lit("band.example.co.uk"), F.lit("label.bandcamp.com"))
    host = F.element_at(sites, (F.col("page_id") % 3 + 1).cast("int"))
    return bound(spark, root, "crawl").select("page_id", web.is_platform(host).alias("is_platform"))


@query("W9", f"""
SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) > 3 THEN 'DOMAIN_BUDGET' END AS skipped FROM crawl
""", "crawl")
def capped_pages_per_host(spark, root):
    return latest.cap_per_key(crawl(spark, root), ["host"], ["page_id"], 3, "DOMAIN_BUDGET").select("page_id", "skipped")


@query("P6, F6, F8, W9", "WITH v AS (SELECT page_id, v.variant, v.reason, CASE v.variant WHEN 0 THEN " + SITE.format(h=HOST) +
       " WHEN 5 THEN '8.8' ELSE 'a.example' END AS dom FROM crawl, (VALUES " + ", ".join(
    f"({i}, {repr(w) if w else 'NULL'})" for i, w in enumerate(WHY)) + """) v(variant, reason)),
o AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY dom, reason IS NULL ORDER BY page_id * 100 + variant) END AS rn FROM v)
SELECT page_id * 100 + variant AS seq, coalesce(reason, CASE WHEN rn > 8 THEN 'DOMAIN_BUDGET' END) AS reason FROM o
""", "crawl")
def fetch_list(spark, root):
    results = url_variants(spark, root).select(F.lit(1).alias("campaign_id"), (F.col("page_id") * 100 + F.col("variant")).alias("seq"), "url")
    return planning.fetch_list(results).select("seq", "reason")


SPACES = "[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
UNESC = "replace(replace(replace(replace({t}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("P1, S7, Z2", f"""
SELECT page_id, nullif(trim(regexp_replace({UNESC.format(t="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')), '') AS title FROM crawl
""", "crawl")
def page_titles(spark, root):
    return read_pages(bound(spark, root, "crawl")).select("page_id", "title")


@query("P1, P2, H20, H21, H22, F13, H16, H17", None)
def page_records(spark, root):
    rows = page_facts.page_records(bound(spark, root, "crawl"))
    return rows.select("page_id", "domain", "page_state", "title", "outlet_name", "classification.label", "classification.confidence",
                       F.col("submissions.state").alias("submissions_open"), F.col("cost.model").alias("cost_model"), F.size("links").alias("links"),
                       F.size("contacts").alias("contacts"), F.length("visible_text").alias("text_length"), F.array_join("genres", ",").alias("genres"),
                       F.col("freshness.date").alias("freshness_date"), F.size("injection_findings").alias("injections"))


def built_pages(spark, root):
    """A page per service whose title, addresses, links and status follow from its own columns."""
    k = F.col("service_id").cast("string")
    at = lambda name: F.concat(F.lit(name), k, F.lit("@d"), k, F.lit(".example"))
    role, person = F.concat(F.lit("info@d"), k, F.lit(".example")), at("zoe")
    third = F.col("service_id") % 3 == 0
    title = (F.when(F.col("service_id") % 4 == 0, F.concat("name", F.lit(" — Site "), k)).when(F.col("service_id") % 4 == 1, F.concat(F.lit("Page | "), "name", F.lit(" | Blog "), k))
             .when(F.col("service_id") % 4 == 2, F.col("name")).otherwise("Just a moment"))
    body = F.concat(F.lit("<p>Write to "), F.when(third, role).otherwise(person), F.lit(" or <a href='mailto:"), F.when(third, person).otherwise(role), F.lit("'>mail us</a>.</p>"),
                    F.when(F.col("service_id") % 5 == 0, F.concat(F.lit("<p>Or "), at("anna"), F.lit("</p>"))).otherwise(""),
                    F.lit("<p><a href='/submit/"), k, F.lit("'>Upload here</a> <a href='/about'>About</a></p>"),
                    F.when(F.col("service_id") % 2 == 1, F.lit("<p>Submissions are open.</p>")).otherwise(""), F.when(F.col("service_id") % 6 == 0, F.lit("<p>We run a DJ pool.</p>")).otherwise(""))
    return bound(spark, root, "services").select(
        "service_id", F.lit(1).alias("tenant_id"), F.concat(F.lit("https://d"), k, F.lit(".example/page")).alias("url"), F.when(F.col("service_id") % 7 == 0, 500).otherwise(200).alias("http_status"),
        F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body>"), body, F.lit("</body></html>")).alias("html"))


BUILT_SQL = """b AS (SELECT service_id, name, service_id % 4 AS t, CASE WHEN service_id % 6 = 0 THEN 'DJ_POOL' WHEN service_id % 4 = 1 THEN 'BLOG' ELSE 'UNKNOWN' END AS label, CASE WHEN service_id % 2 = 1 THEN 'OPEN' ELSE 'UNKNOWN' END AS submissions_open,
 'd' || service_id || '.example' AS domain, CASE WHEN service_id % 4 = 0 THEN name || ' — Site ' || service_id WHEN service_id % 4 = 1 THEN 'Page | ' || name || ' | Blog ' || service_id WHEN service_id % 4 = 2 THEN name ELSE 'Just a moment' END AS title FROM services)"""


@query("P1, P2, F13, H16, H21, H22, H23, O6", f"""
WITH {BUILT_SQL}, c AS (SELECT service_id, 'info@d' || service_id || '.example' AS value, service_id % 3 <> 0 AS mailed, TRUE AS role FROM b
 UNION ALL SELECT service_id, 'zoe' || service_id || '@d' || service_id || '.example', service_id % 3 = 0, FALSE FROM b
 UNION ALL SELECT service_id, 'anna' || service_id || '@d' || service_id || '.example', FALSE, FALSE FROM b WHERE service_id % 5 = 0)
SELECT b.service_id, domain, title, CASE WHEN service_id % 7 = 0 THEN 'ERROR' WHEN t = 3 THEN 'BOT_CHALLENGE' ELSE 'OK' END AS page_state,
 CASE t WHEN 0 THEN 'Site ' || service_id WHEN 1 THEN 'Blog ' || service_id WHEN 2 THEN name ELSE 'Just a moment' END AS outlet_name, label, submissions_open,
 (SELECT string_agg(value || CASE WHEN mailed THEN ' mailto-link' ELSE ' visible-text' END || CASE WHEN role THEN ' role' ELSE '' END, ',' ORDER BY NOT role, NOT mailed, value) FROM c WHERE c.service_id = b.service_id) AS contacts,
 'https://' || domain || '/submit/' || service_id AS submission_links, 'https://' || domain || '/submit/' || service_id AS submission_url,
 'https://' || domain || '/about' AS contact_url, NULL AS terms_url FROM b
""", "services")
def built_page_records(spark, root):
    rows = page_facts.with_declared_links(page_facts.page_records(built_pages(spark, root)))
    return rows.select(
        "service_id", "domain", "title", "page_state", "outlet_name", F.col("classification.label").alias("label"), F.col("submissions.state").alias("submissions_open"),
        F.array_join(F.transform("contacts", lambda c: F.concat_ws(" ", c["value"], c["origin"], F.when(c["role_based"], "role"))), ",").alias("contacts"),
        F.array_join(F.transform("submission_links", lambda x: x["href"]), ",").alias("submission_links"), "declared.submission_url", "declared.contact_url", "declared.terms_url")


@query("P8, S13, A14", f"""
WITH {BUILT_SQL} SELECT domain AS entity_id, 'https://' || domain || '/page' AS source_url, 'classification' AS supports_field, label AS value, CAST(CASE WHEN label <> 'UNKNOWN' THEN 0.6 ELSE 0.0 END AS DOUBLE) AS confidence, 1 AS corroborating_domains FROM b
UNION ALL SELECT domain, 'https://' || domain || '/page', 'submissions_open', 'OPEN', 0.8, 1 FROM b WHERE submissions_open = 'OPEN'
""", "services")
def built_page_evidence(spark, root):
    packets = page_facts.evidence_packets(page_facts.page_records(built_pages(spark, root)), "domain", "outlet", AS_OF)
    return page_facts.provenance(packets, AS_OF).select("entity_id", "source_url", "supports_field", "value", F.col("confidence").cast("double").alias("confidence"), "corroborating_domains")


@query("P7, P8, S13", None)
def page_evidence(spark, root):
    pages = bound(spark, root, "crawl").withColumn("tenant_id", F.lit(1))
    records = page_facts.page_records(pages)
    refused = url_variants(spark, root).select("url", F.lit(1).alias("tenant_id"), web.block_reason("url").alias("block_reason")).filter("block_reason IS NOT NULL")
    docs = page_facts.source_documents(records, refused, AS_OF).groupBy("fetch_status", "domain").agg(F.count("*").alias("rows"))
    facts = page_facts.provenance(page_facts.evidence_packets(records, "domain", "outlet", AS_OF), AS_OF)
    backed = facts.groupBy(F.col("supports_field").alias("fetch_status"), F.col("entity_id").alias("domain")).agg(F.count("*").alias("rows"))
    return docs.unionByName(backed)


@query("P10, P9, C2, E2, E3, E4, K1, K2, K3, K4", None)
def discovery_funnel(spark, root):
    pages = bound(spark, root, "crawl").select(
        "page_id", (F.col("page_id") % 5).cast("int").alias("tenant_id"), (F.col("page_id") % 5).alias("campaign_id"), F.col("page_id").alias("seq"),
        "url", "html", F.lit(200).alias("http_status"))
    none = F.array().cast("array<string>")
    campaigns = pages.select("campaign_id", "tenant_id").distinct().withColumns({
        "mode": F.lit("COPILOT"), "territories": F.array(F.lit("US")), "primary_genre": F.lit("techno"), "secondary_genres": none,
        "microgenres": F.array(F.lit("dark electronic")), "mood": F.array(F.lit("dark")), "playlist_contexts": none, "sender_ready": F.lit(True)})
    blank = "tenant_id int, value_hash string, scope string, reason string"
    out = discovery.discover(
        discovery.crawl_records(pages), campaigns, spark.createDataFrame([], blank),
        spark.createDataFrame([], "tenant_id int, contact_id string, outlet_id string, accepted_count int, declined_count int, placement_count int"),
        spark.createDataFrame([], "tenant_id int, artist_id string, outlet_id string, domain string"), b"registered query key", AS_OF)
    return out.select("campaign_id", "url", "outlet_name", "kind", "status", "score", "risk_score", "risk_band", "decision", "route_method", "members")


@query("P7, S13, H2, X2", """
WITH r AS (SELECT doc_id, 1 AS run, 'OK' AS fetch_status, text, NULL AS block_reason FROM docs WHERE doc_id % 3 <> 0
 UNION ALL SELECT doc_id, 2, 'OK', text || ' again', NULL FROM docs WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 2, 'BLOCKED', NULL, 'ROBOTS_DISALLOWED' FROM docs WHERE doc_id % 10 = 1),
n AS (SELECT *, trim(regexp_replace(text, '{SPACES}', ' ', 'g')) AS flat FROM r WHERE run = (SELECT max(run) FROM r q WHERE q.doc_id = r.doc_id))
SELECT doc_id % 5 AS tenant_id, CASE WHEN doc_id % 4 <> 3 THEN doc_id % 4 END AS campaign_id, 'https://d' || doc_id || '.example/Page' AS url, sha256('https://d' || doc_id || '.example/page') AS url_hash,
 'd' || doc_id || '.example' AS domain, fetch_status, CASE WHEN length(text) > 0 THEN sha256(text) END AS content_hash,
 CASE WHEN length(flat) = 0 THEN NULL WHEN length(flat) <= 2000 THEN flat ELSE rtrim(substr(flat, 1, 2000)) || '…' END AS sanitized_text, block_reason, run FROM n
""".replace("{SPACES}", SPACES), "docs")
def source_document_register(spark, root):
    docs = bound(spark, root, "docs").select(
        (F.col("doc_id") % 5).alias("tenant_id"), F.when(F.col("doc_id") % 4 != 3, F.col("doc_id") % 4).alias("campaign_id"), "doc_id", "text",
        F.format_string("https://d%d.example/Page", "doc_id").alias("url"), F.format_string("d%d.example", "doc_id").alias("domain"))
    path = f"{shared_folder(spark)}/source-documents-{uuid.uuid4().hex}"
    for run, read, text, refused in ((1, "doc_id % 3 <> 0", F.col("text"), "false"), (2, "doc_id % 2 = 0", F.concat("text", F.lit(" again")), "doc_id % 10 = 1")):
        records = docs.filter(read).withColumns({"visible_text": text, "title": F.lit("t"), "classification": F.struct(F.lit("UNKNOWN").alias("label")), "attempted_at": F.lit(run)})
        no = docs.filter(refused).select("tenant_id", "campaign_id", "url", F.lit("ROBOTS_DISALLOWED").alias("block_reason"), F.lit(run).alias("attempted_at"))
        page_facts.keep_documents(path, page_facts.source_documents(records, no, AS_OF))
    return spark.read.parquet(path).select("tenant_id", "campaign_id", "url", "url_hash", "domain", "fetch_status", "content_hash", "sanitized_text", "block_reason",
                                           F.col("attempted_at").alias("run"))


# -- paid services: one page per part, phrased by its type -------------------

PHRASES = {
    "PROMO": "We guarantee playlist placement in a week.",
    "LARGE": "Every sponsored article is written by our team.",
    "SMALL": "Curators alone decide. I am a curator and I review every submission. Refund policy: you can be refunded if late.",
    "MEDIUM": "Submit your music to our network of curators. Placement is never guaranteed.",
    "ECONOMY": "We never guarantee streams. We do not sell plays.",
    "STANDARD": "Music PR campaign management.",
}


def service_pages(spark, root):
    parts = bound(spark, root, "services")
    from wayfold.functions.text import lookup
    text = F.concat(F.lit("<html><head><title>"), "name", F.lit("</title></head><body><p>Our packages start at $"),
                    F.format_string("%.2f", F.coalesce("pricing_min", F.lit(10.0))), F.lit(" per track.</p><p>"), lookup("kind", PHRASES),
                    F.lit("</p><a href='/terms'>Terms</a></body></html>"))
    return parts.select("service_id", F.lit(1).alias("tenant_id"), F.format_string("https://s%d.example/offer", "service_id").alias("url"),
                        text.alias("html"), F.lit("h").alias("content_hash"), F.lit(AS_OF).cast("timestamp").alias("retrieved_at"),
                        F.col("service_id").alias("seq"))


# what a page says, with a gap of growing length: (sentence, signal, its words, facts, words of the first, names an offer)
SAID = [
    ("We guarantee playlist placement in a week.", "guaranteed_placement", "guarantee playlist placement", "", "", False),
    ("We never {gap}guarantee playlist placement.", "guaranteed_placement", "guarantee playlist placement", "", "", False),
    ("Every sponsored article is written by our team.", "", "", "guaranteed_coverage", "sponsored article", True),
    ("Beware of sites that sell. They guarantee 5000 streams.", "guaranteed_streams", "guarantee 5000 streams", "", "", False),
    ("Beware of sites that guarantee 5000 streams.", "", "", "", "", False),
    ("Curators alone decide. Refund policy: you can be refunded if late.", "", "", "placement_discretionary,refund_policy", "Curators alone decide", False),
    ("There is no refund policy here.", "", "", "", "", False),
    ("Curators are never paid for adds.", "", "", "curator_compensation", "Curators are never paid", False),
    ("Our bots listen all day.", "bot_engagement", "bots", "", "", False),
    ("Only plain words stand here.", "", "", "", "", False),
]
OFFERED = ["Our packages start at ${price} per track.", "Fees apply. {names}${price}", "Write to us."]
CUT = """CASE WHEN {at} > 91 THEN '…' ELSE '' END || trim(substr({t}, greatest(1, {at} - 90), {n} + 90 + least({at} - 1, 90)))
   || CASE WHEN {at} - 1 + {n} + 90 < length({t}) THEN '…' ELSE '' END"""


def offer_pages(spark, root):
    """A page per service, its sentences, gaps and prices set by the service's own columns."""
    key = F.col("service_id")
    pick = lambda items, by: F.element_at(F.array(*[F.lit(x) for x in items]), (by + 1).cast("int"))
    names = lambda by: F.repeat(F.concat("name", F.lit(" ")), (key % by).cast("int"))
    said = F.replace(pick([x[0] for x in SAID], key % 10), F.lit("{gap}"), F.repeat(F.lit("truly "), (key % 23).cast("int")))
    price = F.format_string("%.2f", F.coalesce("pricing_min", F.lit(10.0)))
    offered = F.replace(F.replace(pick(OFFERED, F.floor(key / 10) % 3), F.lit("{names}"), names(11)), F.lit("{price}"), price)
    text = F.concat(names(9), said, F.lit(" "), names(5), offered)
    html = F.concat(F.lit("<html><head><title>"), "name", F.lit("</title></head><body><p>"), text, F.lit("</p></body></html>"))
    return bound(spark, root, "services").select("service_id", F.format_string("https://s%d.example/offer", "service_id").alias("url"), html.alias("html"))


@query("K6, Z3, H10, H15, H18, F12", f"""
WITH said(place, sentence, signal, signal_words, facts, fact_words, offers) AS (VALUES {", ".join(f"({i}, '{a}', '{b}', '{c}', '{d}', '{e}', {f})" for i, (a, b, c, d, e, f) in enumerate(SAID))}),
offered(place, sentence) AS (VALUES {", ".join(f"({i}, '{a}')" for i, a in enumerate(OFFERED))}),
p AS (SELECT service_id, name, signal, signal_words, facts, fact_words, offers, o.place AS way, printf('%.2f', coalesce(pricing_min, 10.0)) AS price,
  repeat(name || ' ', CAST(service_id % 9 AS INT)) || replace(s.sentence, '{{gap}}', repeat('truly ', CAST(service_id % 23 AS INT))) || ' '
  || repeat(name || ' ', CAST(service_id % 5 AS INT))
  || replace(replace(o.sentence, '{{names}}', repeat(name || ' ', CAST(service_id % 11 AS INT))), '{{price}}', printf('%.2f', coalesce(pricing_min, 10.0))) AS t
  FROM services JOIN said s ON s.place = service_id % 10 JOIN offered o ON o.place = service_id // 10 % 3),
q AS (SELECT *, name || ' ' || t AS whole, instr(name || ' ' || t, signal_words) AS sat, instr(t, fact_words) AS fat, instr(t, '$') AS pat, instr(t, 'Fees') AS fees,
  instr(name || ' ' || t, 'never') AS never, length(price) + 1 AS pn FROM p),
r AS (SELECT *, way < 2 AND signal <> '' AND NOT (never > 0 AND sat - never <= 90) AS signalled, way = 0 OR (way = 1 AND pat - fees <= 90) AS priced FROM q)
SELECT service_id, CASE WHEN signalled THEN signal ELSE '' END AS signals, CASE WHEN signalled THEN {CUT.format(at="sat", t="whole", n="length(signal_words)")} END AS signal_excerpt,
 facts, CASE WHEN facts <> '' THEN {CUT.format(at="fat", t="t", n="length(fact_words)")} END AS fact_excerpt,
 CASE WHEN priced THEN CAST(price AS DOUBLE) END AS price, CASE WHEN priced THEN 'USD' END AS currency,
 CASE WHEN priced THEN {CUT.format(at="pat", t="t", n="pn")} END AS price_excerpt, way = 0 OR offers AS offer FROM r
""", "services")
def service_page_facts(spark, root):
    rows = page_facts.page_records(offer_pages(spark, root), offers=True)
    first = lambda c: F.get(F.col(c), F.lit(0))["excerpt"]
    return rows.select("service_id", F.array_join(F.transform("signals", lambda s: s["signal"]), ",").alias("signals"), first("signals").alias("signal_excerpt"),
                       F.array_join(F.transform("facts", lambda f: f["field"]), ",").alias("facts"), first("facts").alias("fact_excerpt"),
                       F.col("prices.min").alias("price"), F.col("prices.currency").alias("currency"), F.col("prices.excerpt").alias("price_excerpt"),
                       page_facts.is_offer_page(F.col("whole_text")).alias("offer"))


@query("K7, K8, K9, F9, A10, A16, A17, A18, A19, H28, M2, W7", """
SELECT service_id, CASE kind WHEN 'PROMO' THEN 'BLOCKED' WHEN 'SMALL' THEN 'SCREENED' ELSE 'CAUTION' END AS status,
 CASE kind WHEN 'LARGE' THEN 'PAID_MEDIA_OUTLET' WHEN 'SMALL' THEN 'INDIVIDUAL_CURATOR' WHEN 'MEDIUM' THEN 'PLATFORM' WHEN 'STANDARD' THEN 'PROMOTION_COMPANY' ELSE 'UNKNOWN' END AS category,
 CASE kind WHEN 'PROMO' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'SMALL' THEN 5 ELSE 1 END AS reasons FROM services
""", "services")
def screened_services(spark, root):
    records = page_facts.page_records(service_pages(spark, root), offers=True)
    packets = materialize(promotion.page_packets(records).withColumn("seq", F.col("seq") * 100 + F.col("part")), "packets")
    services = bound(spark, root, "services").select("service_id", "name", F.format_string("s%d.example", "service_id").alias("canonical_domain"),
                                                     F.lit("UNKNOWN").alias("screening_status"))
    pages_read = services.select("service_id", F.lit(2).alias("page_ok_count"))
    out = promotion.screen_services(packets, services, pages_read, False, AS_OF)
    return out.select("service_id", "status", "category", F.size("reasons").alias("reasons"))


@query("K7, E5", "SELECT CAST(service_id AS VARCHAR) AS service, domain, is_new FROM (SELECT service_id, 's' || service_id || '.example' AS domain, FALSE AS is_new FROM services WHERE size > 25 "
       "UNION ALL SELECT sha256('1|s' || service_id || '.example'), 's' || service_id || '.example', TRUE FROM (SELECT CAST(service_id AS VARCHAR) AS service_id, size FROM services) WHERE size <= 25)".replace(
           "SELECT service_id, 's'", "SELECT CAST(service_id AS VARCHAR) AS service_id, 's'"), "services")
def service_registry(spark, root):
    known = bound(spark, root, "services").filter("size > 25").select(F.lit(1).alias("tenant_id"), F.format_string("s%d.example", "service_id").alias("domain"),
                                                                      F.col("service_id").cast("string").alias("service_id"))
    out = promotion.register_services(page_facts.page_records(service_pages(spark, root)), known)
    return out.select(F.col("service_id").alias("service"), "domain", "is_new")




@query("E9, J10, H10, X5, T2", f"""
WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name, FALSE AS lane FROM part UNION ALL SELECT DISTINCT split_part(p_name, ' ', 1), TRUE FROM part),
d AS (SELECT doc_id, text, lower(text) AS low, CASE WHEN length(lower(text)) = length(text) THEN text ELSE lower(text) END AS base,
  regexp_replace(text, '[À-ÖØ-öø-ÿĀ-ſ]', '_', 'g') AS t, 'https://d' || doc_id || '.example/' AS url FROM docs),
m AS (SELECT d.*, w.*, instr(low, lower(name)) AS place FROM d JOIN w ON name <> '' AND contains(low, lower(name)))
SELECT doc_id AS seq, name AS subject, lane,
 CASE WHEN lane THEN CASE WHEN regexp_matches(t, '(?i)\\btrends?\\b|\\btrending\\b|\\bviral\\b|\\bstrateg(y|ies)\\b|\\bplaybook\\b|\\bblowing\\s+up\\b|\\bbreaking\\s+on\\b') THEN 'TREND' ELSE 'UNKNOWN' END
  WHEN regexp_matches(t, '(?i)\\bpremieres?\\b|\\bpremiering\\b') THEN 'PREMIERE' WHEN regexp_matches(t, '(?i)\\binterviews?\\b') THEN 'INTERVIEW' ELSE 'UNKNOWN' END AS kind,
 CASE WHEN place > 101 THEN '…' ELSE '' END || trim(regexp_replace(substr(base, greatest(1, place - 100), length(name) + 100 + least(place - 1, 100)), '{SPACES}', ' ', 'g'))
  || CASE WHEN place - 1 + length(name) + 100 < length(base) THEN '…' ELSE '' END AS excerpt,
 sha256(lower(trim(CASE WHEN lane THEN 'trend|' || name || '|' || url ELSE name || '|' || url END))) AS dedup_key FROM m
""", "docs")
def coverage_events(spark, root):
    records = bound(spark, root, "docs").select(
        F.lit(1).alias("tenant_id"), F.format_string("https://d%d.example/", "doc_id").alias("url"), F.format_string("d%d.example", "doc_id").alias("domain"),
        F.lit("").alias("title"), F.col("text").alias("visible_text"), F.lit(AS_OF).cast("timestamp").alias("retrieved_at"), F.col("doc_id").alias("seq"),
        F.lit("OK").alias("page_state"))
    word = lambda n: bound(spark, root, "services").select(F.lit(1).alias("tenant_id"), F.split_part("name", F.lit(" "), F.lit(n)).alias("name")).distinct()
    watched = word(2).withColumns({"artist_id": F.col("name"), "active": F.lit(True)})
    out = entities.coverage_events(records, watched, word(1).withColumnRenamed("name", "genre_tag"))
    return out.select("seq", "subject", F.col("artist_id").isNull().alias("lane"), "kind", "excerpt", "dedup_key")


@query("E10, J2", f"""
WITH o AS (SELECT min(page_id) AS outlet_id, {HOST} AS host FROM crawl GROUP BY 2), u AS (SELECT url, min(page_id) AS outlet_id FROM crawl WHERE page_id % 2 = 0 GROUP BY 1)
SELECT c.page_id AS event_id, coalesce(u.outlet_id, o.outlet_id) AS outlet_id FROM crawl c LEFT JOIN u ON u.url = c.url LEFT JOIN
 (SELECT {HOST} AS host, min(page_id) AS outlet_id FROM crawl WHERE page_id % 2 = 0 GROUP BY 1) o ON o.host = lower(regexp_extract(c.url, '^[a-z]+://([^/:?#]+)', 1))
""", "crawl")
def event_target_links(spark, root):
    pages = crawl(spark, root).withColumn("tenant_id", F.lit(1))
    events = pages.select("tenant_id", F.col("page_id").alias("event_id"), "url", F.col("host").alias("domain"))
    outlets = pages.filter("page_id % 2 = 0").select("tenant_id", F.col("page_id").alias("outlet_id"), "url", F.col("host").alias("domain"))
    targets = outlets.select(F.lit(1).alias("campaign_id"), "outlet_id", F.col("outlet_id").alias("target_id"))
    return entities.link_events(events, outlets, targets).select("event_id", "outlet_id")


@query("P5, J17, H27, W9", """
WITH a AS (SELECT DISTINCT p_type AS tenant_id, p_brand AS name FROM part), q AS (SELECT tenant_id, name, t.place, replace(t.tpl, '{name}', name) AS query FROM a,
 (VALUES (0, '"{name}" premiere OR review'), (1, '"{name}" interview OR feature'), (2, '"{name}" playlist OR "added to"')) t(place, tpl))
SELECT tenant_id, query, rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY name, place) AS rank FROM q) WHERE rank <= 60
""")
def coverage_query_plan(spark, root):
    watched = bound(spark, root, "services").select(F.col("kind").alias("tenant_id"), F.col("brand").alias("name")).distinct().withColumns({
        "artist_id": F.col("name"), "active": F.lit(True), "created_at": F.lit(0), "seq": F.col("name")})
    out = planning.coverage_queries(watched, 60)
    return out.select("tenant_id", "query", F.col("rank").cast("bigint").alias("rank"))


@query("P5, U1", """
WITH n AS (SELECT DISTINCT p_type AS tenant_id, CASE WHEN p_size <= 20 THEN 'GENRE' WHEN p_size <= 35 THEN 'MICRO' ELSE 'ARTIST' END AS source, p_brand AS name FROM part),
q AS (SELECT tenant_id, source, name, t.place, replace(t.tpl, '{name}', name) AS query, CASE source WHEN 'GENRE' THEN 0 WHEN 'MICRO' THEN 1 ELSE 2 END AS grp FROM n JOIN
 (VALUES ('GENRE', 0, '"{name}" tiktok trend'), ('GENRE', 1, '"{name}" viral'), ('MICRO', 0, '"{name}" playlist trend'), ('ARTIST', 0, '"{name}" viral OR tiktok')) t(src, place, tpl) ON t.src = n.source)
SELECT tenant_id, query, rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY grp, name, place) AS rank FROM q) WHERE rank <= 20
""")
def trend_query_plan(spark, root):
    size = F.col("size")
    names = bound(spark, root, "services").select(F.col("kind").alias("tenant_id"), F.when(size <= 20, "GENRE").when(size <= 35, "MICRO").otherwise("ARTIST").alias("source"),
                                                  F.col("brand").alias("name")).distinct().withColumn("seq", F.col("name"))
    return planning.trend_queries(names).select("tenant_id", "query", F.col("rank").cast("bigint").alias("rank"))


def campaign_settings(spark, root):
    """Channels, territories and profile values of every campaign, from its own columns."""
    key = F.col("campaign_id")
    genres = F.array(*[F.lit(g) for g in rules.GENRES])
    pick = lambda by: F.element_at(genres, (key * by % len(rules.GENRES) + 1).cast("int"))
    channels = {"BUILDING": "PLAYLIST", "AUTOMOBILE": "BLOG", "MACHINERY": "DJ", "HOUSEHOLD": "RADIO", "FURNITURE": "CURATOR"}
    lands = F.array(*[F.lit(x) for x in sorted(rules.LANGUAGE_TEMPLATES)])
    from wayfold.functions.text import lookup
    return bound(spark, root, "campaigns").select(
        "campaign_id", "tenant_id", F.array(lookup("segment", channels), F.lit("PODCAST")).alias("channels"),
        F.array(F.element_at(lands, (F.col("tenant_id") % len(rules.LANGUAGE_TEMPLATES) + 1).cast("int"))).alias("territories"),
        F.array(pick(1), pick(3)).alias("genres"), F.array(pick(7)).alias("microgenres"), F.array("name").alias("comparable_artists"),
        F.lit("club").alias("scene"), F.array(F.lit("college")).alias("radio_formats"))


def _rows(items) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in items)


GENRE_LIST = "[" + ", ".join("'" + g + "'" for g in rules.GENRES) + "]"
LAND_LIST = "[" + ", ".join(f"'{x}'" for x in sorted(rules.LANGUAGE_TEMPLATES)) + "]"
SETTINGS_SQL = f"""s AS (SELECT campaign_id, tenant_id, name, CASE segment WHEN 'BUILDING' THEN 'PLAYLIST' WHEN 'AUTOMOBILE' THEN 'BLOG' WHEN 'MACHINERY' THEN 'DJ'
  WHEN 'HOUSEHOLD' THEN 'RADIO' ELSE 'CURATOR' END AS channel, {LAND_LIST}[tenant_id % {len(rules.LANGUAGE_TEMPLATES)} + 1] AS land,
 [{GENRE_LIST}[campaign_id % {len(rules.GENRES)} + 1], {GENRE_LIST}[campaign_id * 3 % {len(rules.GENRES)} + 1]] AS genres, {GENRE_LIST}[campaign_id * 7 % {len(rules.GENRES)} + 1] AS micro FROM campaigns)"""
PLAN_TAIL = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k}, lower(query) ORDER BY p) AS once FROM q) WHERE once = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY {k}, family ORDER BY p) AS turn FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY turn, family) AS position FROM f)
SELECT {k}, family, query, {more}turn, position FROM o WHERE position <= {n}"""
FILL = "replace(replace(x.tpl, '{genre}', v.value), '{microgenre}', v.value)"


@query("P3, J17, H27, U1, W5", f"""
WITH {SETTINGS_SQL}, v AS (SELECT campaign_id, unnest(list_concat(genres, [micro])) AS value, generate_subscripts(list_concat(genres, [micro]), 1) AS i FROM s),
c AS (SELECT campaign_id, 0 AS ci, channel FROM s UNION ALL SELECT campaign_id, 1, 'PODCAST' FROM s),
q AS (SELECT c.campaign_id, c.channel AS family, c.ci * 10000 + x.ti * 100 + v.i AS p, {FILL} AS query, NULL AS territory, 'en' AS language FROM c JOIN v ON v.campaign_id = c.campaign_id
  JOIN (VALUES {_rows([(ch, i, t) for ch, ts in rules.CHANNEL_TEMPLATES.items() for i, t in enumerate(ts)])}) x(channel, ti, tpl) ON x.channel = c.channel
 UNION ALL SELECT campaign_id, 'COMPARABLE', 30000, 'playlists featuring ' || name, NULL, 'en' FROM s UNION ALL SELECT campaign_id, 'COMPARABLE', 30001, name || ' similar artists submissions', NULL, 'en' FROM s
 UNION ALL SELECT campaign_id, 'SCENE', 30002, 'club scene submit music', NULL, 'en' FROM s UNION ALL SELECT campaign_id, 'RADIO', 30003, 'college radio format submissions', NULL, 'en' FROM s
 UNION ALL SELECT s.campaign_id, 'LOCAL_LANGUAGE', 40000 + x.ti, replace(x.tpl, '{{genre}}', s.micro), s.land, lower(s.land) FROM s
  JOIN (VALUES {_rows([(t, i, x) for t, ts in rules.LANGUAGE_TEMPLATES.items() for i, x in enumerate(ts)])}) x(land, ti, tpl) ON x.land = s.land
 UNION ALL SELECT campaign_id, 'TERRITORY', 50000, land || ' ' || micro || ' playlist curator', land, 'en' FROM s),
""" + PLAN_TAIL.format(k="campaign_id", more="territory, language, ", n=24), "campaigns")
def campaign_query_plan(spark, root):
    out = planning.campaign_queries(campaign_settings(spark, root)).select(
        "campaign_id", "family", "query", "territory", "language", "turn", "position")
    return out.withColumns({"turn": F.col("turn").cast("bigint"), "position": F.col("position").cast("bigint")})


@query("P4, U6, W5", f"""
WITH {SETTINGS_SQL}, t AS (SELECT tenant_id, arg_min(list_concat(genres, [micro]), campaign_id) AS vals, arg_min(land, campaign_id) AS land FROM s GROUP BY 1),
v AS (SELECT tenant_id, land, unnest(vals) AS value, generate_subscripts(vals, 1) AS i FROM t),
q AS (SELECT v.tenant_id, x.family, x.ti * 100 + v.i AS p, replace({FILL}, '{{territory}}', v.land) AS query FROM v, (VALUES {_rows([(f, i, t) for i, (f, t) in enumerate(
    (f, t) for f, ts in rules.PROMOTION_TEMPLATES.items() for t in ts)])}) x(family, ti, tpl)
 UNION ALL SELECT t.tenant_id, 'SEED', 100000 + x.ti, '"' || x.name || '" pricing submission terms' FROM t, (VALUES {_rows(list(enumerate(rules.SEED_SERVICES)))}) x(ti, name)),
""" + PLAN_TAIL.format(k="tenant_id", more="", n=40), "campaigns")
def promotion_query_plan(spark, root):
    tenants = campaign_settings(spark, root).groupBy("tenant_id").agg(
        F.min_by("genres", "campaign_id").alias("genres"), F.min_by("microgenres", "campaign_id").alias("microgenres"),
        F.min_by("territories", "campaign_id").alias("territories"))
    out = planning.promotion_queries(tenants).select("tenant_id", "family", "query", "turn", "position")
    return out.withColumns({"turn": F.col("turn").cast("bigint"), "position": F.col("position").cast("bigint")})


@query("E9, W9, U1", """
WITH n AS (SELECT p_type AS tenant_id, lower(p_brand) AS f, min(p_partkey) AS seq FROM part GROUP BY 1, 2)
SELECT tenant_id, f AS folded, place FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS place FROM n) WHERE place <= 20
""")
def watch_list(spark, root):
    names = bound(spark, root, "services").select(F.col("kind").alias("tenant_id"), F.col("brand").alias("name"), F.col("service_id").alias("seq"))
    out = planning.watch_list(names)
    return out.select("tenant_id", F.lower("name").alias("folded"), F.col("place").cast("bigint").alias("place"))
