"""Text queries on documents, passages and conversations, always over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import keys as ky
from wayfold.functions import score as sc
from wayfold.functions import text as tx
from wayfold.functions import web
from wayfold.operators import containment, latest
from wayfold.plans import outreach, page_facts
from wayfold.registry.base import bound, query
from wayfold.session import spread

# RE2 knows ASCII word boundaries only, so the checking SQL turns letters with
# accents into a plain word character before it tests a pattern.
PLAIN = "regexp_replace(text, '[À-ÖØ-öø-ÿĀ-ſ]', '_', 'g')"


def _quote(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _case(rule_list, column: str = "t", default: str = "'UNKNOWN'") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {_quote(p)}) THEN '{label}'" for label, p in rule_list) + f" ELSE {default} END"


def _any(patterns, column: str = "t") -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_quote(p)})" for p in patterns) + ")"


def _labels(rule_list, column: str = "t") -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({column}, {_quote(p)}) THEN '{label}' END" for label, p in rule_list) + ")"


def folded_docs(spark, root):
    return spread(bound(spark, root, "docs")).withColumn("low", tx.fold("text"))


@query("J10", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def passages_in_documents(spark, root):
    passages = spark.read.parquet(f"{root}/benchmark.parquet").select("item_id", F.col("text").alias("passage"))
    return containment.contains_join(bound(spark, root, "docs").select("doc_id", "text"), passages, ["doc_id"], "text", "passage").select("doc_id", "item_id")


@query("J10, E9", """
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part)
SELECT d.doc_id, d.lang, w.name FROM documents d JOIN w ON contains(lower(d.text), lower(w.name))
""")
def watched_words_in_documents(spark, root):
    words = bound(spark, root, "services").select(F.explode(F.split("name", " ")).alias("name")).distinct()
    return containment.contains_join(bound(spark, root, "docs").select("doc_id", "lang", "text"), words, ["doc_id"], "text", "name").select("doc_id", "lang", "name")


@query("J11, W6, H31", """
WITH q AS (SELECT DISTINCT p_name AS query FROM part), t AS (SELECT query, unnest(regexp_extract_all(lower(query), '[a-z0-9&'']+')) AS term FROM q),
u AS (SELECT query, term, count(*) AS times FROM t WHERE term NOT IN ('the','a','an','to','for','of','and','or','in','on','with','submit','submissions','music','your') GROUP BY 1, 2),
s AS (SELECT u.query, d.doc_id, sum(u.times) AS score FROM u JOIN documents d ON contains(lower(d.text), u.term) GROUP BY 1, 2)
SELECT query, doc_id, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5
""")
def term_search(spark, root):
    asked = bound(spark, root, "services").select(F.col("name").alias("query")).distinct().withColumn("query_id", F.col("query"))
    out = containment.term_search(bound(spark, root, "docs"), asked, "doc_id", "text", "query_id", "query", 5)
    return out.select(F.col("query_id").alias("query"), "doc_id", F.col("score").cast("bigint"), F.col("rank").cast("bigint").alias("rank"))


@query("A14, S13", """
SELECT lang, CAST(floor(ln(n_chars + 1)) AS BIGINT) AS band, count(DISTINCT source) AS corroborating_domains FROM docs GROUP BY 1, 2
""", "docs")
def corroboration_by_language(spark, root):
    rows = bound(spark, root, "docs").select(
        F.lit("doc").alias("entity_type"), F.col("lang").alias("entity_id"), F.floor(F.log(F.col("n_chars") + 1)).cast("bigint").alias("supports_field"),
        F.col("source").alias("source_domain"))
    return page_facts.corroboration(rows).select(F.col("entity_id").alias("lang"), F.col("supports_field").alias("band"), "corroborating_domains")


HMAC_KEY = b"fixed key of the registered query"
INNER = bytes(b ^ 0x36 for b in HMAC_KEY.ljust(64, b"\0")).hex()
OUTER = bytes(b ^ 0x5C for b in HMAC_KEY.ljust(64, b"\0")).hex()
ROLES = ", ".join(f"'{r}'" for r in rules.ROLE_LOCAL_PARTS)
FREE = ", ".join(f"'{r}'" for r in rules.FREEMAIL_LABELS)


@query("H7, H8, H9, X3, C1", f"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{rules.EMAIL}')) AS raw FROM docs),
n AS (SELECT doc_id, raw, lower(trim(raw)) AS v, split_part(split_part(lower(trim(raw)), '@', 1), '+', 1) AS local, split_part(lower(trim(raw)), '@', 2) AS dom FROM e)
SELECT doc_id, raw, local || '@' || dom AS normalized, substr(local, 1, CASE WHEN length(local) > 2 THEN 2 ELSE 1 END) || '•••@' || dom AS preview,
 split_part(v, '@', 1) IN ({ROLES}) AS role_based, split_part(dom, '.', 1) IN ({FREE}) AS freemail, regexp_full_match(split_part(v, '@', 1), '[a-z]+[._-][a-z]+[0-9]*') AS personal,
 sha256(from_hex('{OUTER}') || from_hex(sha256(from_hex('{INNER}') || encode(local || '@' || dom)))) AS keyed FROM n
""", "docs")
def document_addresses(spark, root):
    raw = F.explode(F.regexp_extract_all("text", F.lit(rules.EMAIL), F.lit(0))).alias("raw")
    rows = bound(spark, root, "docs").filter(F.contains("text", F.lit("@"))).select("doc_id", raw)
    local = tx.email_local("raw")
    return rows.select("doc_id", "raw", tx.normalize_email("raw").alias("normalized"), tx.preview_email("raw").alias("preview"),
                       tx.is_role_mailbox(local).alias("role_based"), tx.is_freemail(tx.email_domain("raw")).alias("freemail"),
                       tx.looks_personal(local).alias("personal"), ky.keyed_hash("raw", HMAC_KEY).alias("keyed"))


@query("H1, H2", """
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM docs)
SELECT doc_id, CASE WHEN length(t) = 0 THEN NULL WHEN length(t) <= 400 THEN t ELSE rtrim(substr(t, 1, 400)) || '…' END AS excerpt FROM f
""", "docs")
def bounded_excerpts(spark, root):
    return bound(spark, root, "docs").select("doc_id", tx.bounded_excerpt("text").alias("excerpt"))


@query("H5, H6", """
SELECT service_id, trim(regexp_replace(lower(trim(name || ' / ' || brand)), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
 regexp_replace(lower(name || brand), '[^a-z0-9]', '', 'g') AS name_key FROM services
""", "services")
def slugs(spark, root):
    s = bound(spark, root, "services")
    return s.select("service_id", tx.slug(F.concat_ws(" / ", "name", "brand")).alias("slug"), tx.name_key(F.concat("name", "brand")).alias("name_key"))


SECRETS = [(label, p) if i else (label, p) for p, label, i in rules.SECRET_RULES]


@query("H24, H25, H26", f"""
WITH a AS (SELECT 'd' || doc_id AS id, text FROM docs UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM turns), b AS (SELECT id, {PLAIN} AS t FROM a)
SELECT id, regexp_matches(t, '(?i){rules.OPT_OUT}') AS opt_out, {_any([p for p, _ in rules.INJECTION_RULES])} AS injection,
 (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest([v for v in [{', '.join(
     f"CASE WHEN regexp_matches(t, '{'(?i)' if i else ''}{p}') THEN '{label}' END" for p, label, i in rules.SECRET_RULES)}] if v IS NOT NULL]) AS x)) AS secrets FROM b
""", "docs turns")
def guarded_phrases(spark, root):
    both = bound(spark, root, "docs").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(
        bound(spark, root, "turns").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text"))
    low = F.col("low")
    labels = tx.secret_labels("text", low)
    return both.withColumn("low", tx.fold("text")).select("id", tx.looks_like_opt_out("text", low).alias("opt_out"), (F.size(tx.injection_labels("text", folded=[low])) > 0).alias("injection"),
                       F.when(F.size(labels) > 0, F.array_join(labels, ",")).alias("secrets"))


@query("H12", f"SELECT doc_id, {_case(rules.COVERAGE_KIND_RULES)} AS kind, {_case(rules.TREND_RULES)} AS trend, {_case(rules.CATEGORY_RULES)} AS category "
       f"FROM (SELECT doc_id, {PLAIN} AS t FROM docs)", "docs")
def first_match_rules(spark, root):
    label = lambda rule_list: tx.first_label(None, F.col("text"), rule_list, folded=F.col("low"))
    return folded_docs(spark, root).select("doc_id", label(rules.COVERAGE_KIND_RULES).alias("kind"), label(rules.TREND_RULES).alias("trend"),
                                           label(rules.CATEGORY_RULES).alias("category"))


@query("H13", f"SELECT doc_id, {_labels(rules.SERVICE_TYPE_RULES)} AS service_types FROM (SELECT doc_id, {PLAIN} AS t FROM docs)", "docs")
def all_match_rules(spark, root):
    return folded_docs(spark, root).select("doc_id", F.array_join(tx.all_labels("text", rules.SERVICE_TYPE_RULES, F.col("low")), ",").alias("service_types"))


def _re2(pattern: str) -> str:
    return pattern.replace("(?<!no )(?<!not )(?<!free of )", "")


@query("H11", "WITH b AS (SELECT doc_id, " + PLAIN + " AS t FROM docs), m AS (SELECT doc_id, list_max([" + ", ".join(
    f"CASE WHEN regexp_matches(t, {_quote(_re2(p))}) THEN {w} * 1000 - {i} END" for i, (_l, w, p) in enumerate(rules.PAGE_CLASS_RULES)) + "]) AS best FROM b) "
    "SELECT doc_id, CASE " + " ".join(f"WHEN best = {w * 1000 - i} THEN '{label}'" for i, (label, w, _p) in enumerate(rules.PAGE_CLASS_RULES)) +
    " ELSE 'UNKNOWN' END AS label FROM m", "docs")
def page_class_of_text(spark, root):
    hit = F.array_max(page_facts.class_matches(F.col("text"), F.lit(""), F.col("low")))
    return folded_docs(spark, root).select("doc_id", F.coalesce(hit["label"], F.lit("UNKNOWN")).alias("label"))


@query("H16, H17, H19", f"""
SELECT doc_id, CASE WHEN {_any(rules.CLOSED_PATTERNS)} THEN 'CLOSED' WHEN {_any(rules.OPEN_PATTERNS)} THEN 'OPEN' ELSE 'UNKNOWN' END AS state,
 CASE WHEN regexp_matches(t, {_quote(rules.FREE_SUBMISSION_PATTERN)}) THEN 'FREE_SUBMISSION' WHEN regexp_matches(t, {_quote(rules.FEE_PATTERN)}) THEN 'PAID_CONSIDERATION'
  WHEN regexp_matches(t, {_quote(rules.AD_OFFER_PATTERN)}) THEN 'ADVERTISING_OR_SPONSORSHIP' ELSE 'UNKNOWN' END AS cost_model,
 {_any(rules.LOGIN_PATTERNS)} AS requires_login, regexp_matches(t, {_quote(rules.CAPTCHA_PATTERN)}) AS requires_captcha FROM (SELECT doc_id, {PLAIN} AS t FROM docs)
""", "docs")
def submission_and_cost_of_text(spark, root):
    text, low = F.col("text"), F.col("low")
    return folded_docs(spark, root).select(
        "doc_id", page_facts.submissions(text, low)["state"].alias("state"), page_facts.cost(text, F.lit("UNKNOWN"), low)["model"].alias("cost_model"),
        tx.matches_any(text, rules.LOGIN_PATTERNS, low).alias("requires_login"), tx.matches(text, rules.CAPTCHA_PATTERN, folded=low).alias("requires_captcha"))


@query("H20", f"""
WITH b AS (SELECT doc_id, {PLAIN} AS t FROM docs), d AS (SELECT doc_id, list_max(list_concat(regexp_extract_all(t, {_quote(rules.ISO_DATE_PATTERN)}, 1),
 regexp_extract_all(t, {_quote(rules.MONTH_DATE_PATTERN)}, 1))) AS date FROM b) SELECT doc_id, date, CASE WHEN date IS NOT NULL THEN 'page-text' END AS source FROM d
""", "docs")
def dates_in_text(spark, root):
    f = page_facts.freshness(F.lit(None).cast("string"), F.col("text"))
    return bound(spark, root, "docs").select("doc_id", f["date"].alias("date"), f["source"].alias("source"))


@query("H13", "SELECT doc_id, " + "concat_ws(',', " + ", ".join(
    f"CASE WHEN regexp_matches(t, '(?i)\\b{g.replace('&', '&')}\\b') THEN '{g}' END" for g in rules.GENRES if " " in g or "-" in g) + ", " + ", ".join(
    f"CASE WHEN regexp_matches(t, '(?i)\\b{g}\\b')" + "".join(
        f" AND NOT regexp_matches(t, '(?i)\\b{s}\\b')" for s in rules.GENRES if " " in s and g in s.split(" ")) + f" THEN '{g}' END"
    for g in rules.GENRES if " " not in g and "-" not in g) + f") AS genres FROM (SELECT doc_id, {PLAIN} AS t FROM docs)", "docs")
def genres_of_text(spark, root):
    return folded_docs(spark, root).select("doc_id", F.array_join(tx.genres_in("text", F.col("low")), ",").alias("genres"))


@query("X2", "SELECT doc_id, sha256(text) AS content_hash FROM docs", "docs")
def content_hashes(spark, root):
    return bound(spark, root, "docs").select("doc_id", ky.content_hash("text").alias("content_hash"))


@query("X6, X1", """
SELECT conv_id, turn, sha256('{"attachments":[],"body":' || to_json(text)::VARCHAR || ',"cost":' || printf('%.2f', turn / 4.0) || ',"from_email":"a@b.example","links":["l1","l2"],"recipient_hash":'
 || to_json(role)::VARCHAR || ',"subject":' || to_json('Turn ' || turn)::VARCHAR || '}') AS payload_hash FROM turns
""", "turns")
def message_payload_hashes(spark, root):
    links = F.array(F.lit("l2"), F.lit("l1"))
    digest = ky.payload_hash(F.col("role"), F.concat(F.lit("Turn "), "turn"), F.col("text"), links, F.array().cast("array<string>"),
                             F.col("turn") / 4.0, F.lit("a@b.example"))
    return bound(spark, root, "turns").select("conv_id", "turn", digest.alias("payload_hash"))


@query("L4, H26, H30", f"""
SELECT conv_id, turn, kind, CASE kind WHEN 'ACCEPT' THEN 'POSITIVE' WHEN 'OPT_OUT' THEN 'NEGATIVE' WHEN 'BOUNCE' THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment, body_excerpt FROM (
 SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN regexp_matches({PLAIN}, '(?i){rules.OPT_OUT}') THEN 'OPT_OUT' ELSE 'REPLY' END
  WHEN role = 'assistant' THEN 'ACCEPT' ELSE 'BOUNCE' END AS kind, CASE WHEN length(text) > 0 THEN substr(text, 1, 600) END AS body_excerpt FROM turns)
""", "turns")
def responses_of_conversations(spark, root):
    kinds = {"user": "REPLY", "assistant": "ACCEPT", "system": "BOUNCE"}
    rows = bound(spark, root, "turns").select("conv_id", "turn", tx.lookup("role", kinds).alias("kind"), F.col("text").alias("body"))
    return outreach.responses_with_kind(rows).select("conv_id", "turn", "kind", "sentiment", "body_excerpt")


@query("F10, F11", """
WITH p AS (SELECT d.source, avg(l.quality) >= 0.5 AS ok FROM docs d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1),
g AS (SELECT DISTINCT lang, CAST(floor(ln(n_chars + 1)) AS BIGINT) AS band, source FROM docs)
SELECT g.lang, g.band, bool_and(coalesce(p.ok, FALSE)) AS allowed, coalesce(string_agg(DISTINCT CASE WHEN p.ok IS NULL THEN 'unregistered' WHEN NOT p.ok THEN g.source END, ',' ORDER BY
 CASE WHEN p.ok IS NULL THEN 'unregistered' WHEN NOT p.ok THEN g.source END), '') AS blocked_sources FROM g LEFT JOIN p ON p.source = g.source GROUP BY 1, 2
""", "docs")
def source_use_gate(spark, root):
    docs = bound(spark, root, "docs").withColumn("band", F.floor(F.log(F.col("n_chars") + 1)).cast("bigint"))
    labels = spark.read.parquet(f"{root}/labels.parquet").select("doc_id", "quality")
    policies = docs.join(labels, "doc_id").groupBy("source").agg((F.avg("quality") >= 0.5).alias("may_send_to_llm"))
    out = outreach.guard_sources(docs, policies, ["lang", "band"], "may_send_to_llm")
    return out.withColumn("blocked_sources", F.array_join("blocked_sources", ","))


@query("W5", """
SELECT doc_id, source, turn, position FROM (SELECT *, row_number() OVER (ORDER BY turn, source) AS position FROM (
 SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM docs)) WHERE position <= 40
""", "docs")
def documents_interleaved(spark, root):
    rows = bound(spark, root, "docs").select(F.lit(1).alias("scope"), "doc_id", "source")
    out = latest.round_robin(rows, ["scope"], "source", ["doc_id"], 40)
    return out.select("doc_id", "source", F.col("turn").cast("bigint").alias("turn"), F.col("position").cast("bigint").alias("position"))


@query("H14, U3, U4", """
WITH t AS (SELECT conv_id, turn, list_distinct([lower(trim(x)) for x in string_split(text, ' ') if length(trim(x)) > 0]) AS w FROM turns),
p AS (SELECT a.conv_id, a.turn, a.w AS l, b.w AS r FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN len(l) = 0 OR len(r) = 0 THEN NULL WHEN len(list_intersect(l, r)) > 0 THEN least(1.0, len(list_intersect(l, r)) / least(len(l), 3))
 WHEN EXISTS (SELECT 1 FROM unnest(l) x(a), unnest(r) y(b) WHERE contains(a, b) OR contains(b, a)) THEN 0.5 ELSE 0.0 END::DOUBLE AS overlap,
 CAST(len(l) - len(list_intersect(l, r)) AS BIGINT) AS only_left FROM p
""", "turns")
def word_overlap_of_turns(spark, root):
    t = bound(spark, root, "turns").select("conv_id", "turn", F.split("text", " ").alias("w"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("r"))
    rows = t.join(nxt, ["conv_id", "turn"])
    norm = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: F.length(x) > 0))
    return rows.select("conv_id", "turn", sc.overlap("w", "r").alias("overlap"),
                       F.size(F.array_except(norm("w"), norm("r"))).cast("bigint").alias("only_left"))


@query("U2, U6", """
SELECT DISTINCT lower(value) AS value FROM (SELECT source AS value FROM docs UNION ALL SELECT lang FROM docs UNION ALL SELECT role FROM turns)
""", "docs turns")
def united_values(spark, root):
    docs = bound(spark, root, "docs")
    both = (docs.select("source").unionByName(docs.select(F.col("lang").alias("source")))
            .unionByName(bound(spark, root, "turns").select(F.col("role").alias("source"))))
    rows = both.select(F.lit(1).alias("scope"), F.col("source").alias("value"))
    out = latest.ordered_distinct(rows, ["scope"], "value", ["value"])
    return out.select(F.lower("value").alias("value"))


@query("H10", f"""
WITH b AS (SELECT doc_id, text, strpos(lower(text), ' the ') AS at FROM docs), c AS (SELECT doc_id, text, at, length(text) AS n, greatest(0, at - 1 - 80) AS s, least(length(text), at - 1 + 5 + 80) AS e FROM b WHERE at > 0)
SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, s + 1, e - s), '\\s+', ' ', 'g')) || CASE WHEN e < n THEN '…' ELSE '' END AS excerpt FROM c
""".replace(" AS at", " AS pos").replace("at > 0", "pos > 0").replace("text, at,", "text, pos,").replace("at - 1", "pos - 1"), "docs")
def passages_around_match(spark, root):
    rows = bound(spark, root, "docs").select("doc_id", tx.excerpt_around("text", " the ", 160).alias("excerpt"))
    return rows.filter(F.col("excerpt").isNotNull())


@query("J18, H3", """
WITH e AS (SELECT doc_id, lower(split_part(unnest(regexp_extract_all(text, '""" + rules.EMAIL + """')), '@', 2)) AS dom FROM docs),
r AS (SELECT doc_id, array_to_string(string_split(dom, '.')[-2:], '.') AS site FROM e)
SELECT site, count(*) AS addresses, count(DISTINCT doc_id) AS documents FROM r GROUP BY 1
""", "docs")
def address_domains(spark, root):
    raw = F.explode(F.regexp_extract_all("text", F.lit(rules.EMAIL), F.lit(0))).alias("raw")
    rows = bound(spark, root, "docs").filter(F.contains("text", F.lit("@"))).select("doc_id", raw)
    site = web.registrable_domain(tx.email_domain("raw"))
    return rows.groupBy(site.alias("site")).agg(F.count("*").alias("addresses"), F.countDistinct("doc_id").alias("documents"))
