import pytest
from pyspark.sql import functions as F

from wayfold.plans import contacts, discovery, entities, page_facts
from wayfold.sources import markup
from tests.corpus import PAGES, page

AS_OF = "2024-03-01 00:00:00"
KEY = b"test key"


@pytest.fixture(scope="module")
def records(spark):
    rows = [(1, 1, i, url, body, 502 if "gone" in url else 200) for i, (url, body) in enumerate(PAGES.items())]
    df = spark.createDataFrame(rows, "tenant_id int, campaign_id int, seq int, url string, html string, http_status int").repartition(3)
    return discovery.crawl_records(df).cache()


@pytest.fixture(scope="module")
def by_host(records):
    return {r["url"].split("/")[2] + "/" + r["url"].split("/")[3]: r for r in records.collect()}


def test_title_links_and_text():
    r = markup.read(PAGES["https://nightshift.example/submit"], "https://nightshift.example/submit")
    assert r["title"] == "Submit — Nightshift" and r["meta_description"] == "A late night blog"
    assert r["emails"] == [{"value": "Demos@nightshift.example", "origin": "mailto-link", "text": "our inbox"}]
    assert r["last_modified_hint"].startswith("2024-02-20")


def test_unclosed_title_does_not_swallow_the_page():
    r = markup.read(PAGES["https://broken.example/"], "https://broken.example/")
    assert r["title"] is None and "Music blog" in r["visible_text"]
    assert r["emails"][0]["value"] == "info@broken.example"


def test_hidden_markup_is_apart_and_any_end_tag_leaves_one_level():
    r = markup.read("<div hidden>a <b>b</b> c</div>d<!-- note -->", "")
    assert "a" in r["hidden_text"] and "note" in r["hidden_text"] and "d" in r["visible_text"] and "c" in r["visible_text"]


def test_forms_leave_the_text_but_are_kept():
    r = markup.read(PAGES["https://robot.example/"], "https://robot.example/")
    assert r["forms"] == [{"action": "https://robot.example/go", "method": "post"}]


def test_scripts_are_dropped_whole():
    r = markup.read("<p>a</p><script>var x = '<p>no</p>'; </script><style>p{}</style><svg><p>no</p></svg><p>b</p>", "")
    assert "no" not in r["visible_text"] and r["visible_text"].split() == ["a", "b"]


def test_page_states(by_host):
    assert by_host["check.example/"]["page_state"] == "BOT_CHALLENGE"
    assert by_host["gone.example/"]["page_state"] == "ERROR"
    assert by_host["fm.example/"]["page_state"] == "OK"


def test_classes_with_title_bonus(by_host):
    label = {k: (r["classification"]["label"], round(r["classification"]["confidence"], 2)) for k, r in by_host.items()}
    assert label["fm.example/"] == ("RADIO", 0.55)  # 55 in the text, 52 with the bonus
    assert label["sold.example/"] == ("GUARANTEED_STREAMS", 0.95)
    assert label["nightshift.example/submit"][0] == "BLOG" or label["nightshift.example/submit"][0] == "SUBMISSION_GUIDELINES"
    assert label["gone.example/"] == ("UNKNOWN", 0.0)


def test_submissions_cost_and_walls(by_host):
    assert by_host["nightshift.example/submit"]["submissions"]["state"] == "OPEN"
    assert by_host["shut.example/"]["submissions"]["state"] == "CLOSED"
    assert by_host["fm.example/"]["submissions"]["state"] == "UNKNOWN" and by_host["fm.example/"]["submissions"]["excerpt"] is None
    fee = by_host["fee.example/"]["cost"]
    assert (fee["model"], fee["amount"], fee["currency"]) == ("PAID_CONSIDERATION", 12.5, "EUR")
    assert by_host["nightshift.example/submit"]["cost"]["model"] == "FREE_SUBMISSION"
    assert by_host["wall.example/"]["requires_login"] and by_host["robot.example/"]["requires_captcha"]


def test_names_genres_and_dates(by_host):
    night = by_host["nightshift.example/submit"]
    assert night["outlet_name"] == "Nightshift" and night["genres"] == ["dark electronic", "techno"]
    assert night["freshness"]["date"] == "2024-02-20" and night["freshness"]["source"] == "markup"
    assert by_host["fm.example/"]["freshness"]["date"] == "2021-05-01"
    assert by_host["fee.example/"]["submission_links"][0]["href"] == "https://fee.example/send"


def test_injection_and_honeypot(by_host):
    trap = by_host["trap.example/"]
    assert trap["injection_findings"] == ["override-instructions"] and trap["hidden_emails"] == ["secret@trap.example"]


def test_contact_categories(records):
    got = {(r["value"].lower(), r["category"]) for r in contacts.methods_from_pages(records, KEY).collect()}
    assert ("secret@trap.example", "PROHIBITED_PRIVATE_INFORMATION") in got
    assert ("jo.doe@gmail.com", "PERSONAL_ADDRESS") in got
    assert ("hello@trap.example", "VERIFIED_PUBLIC_BUSINESS") in got
    assert any(v == "demos@nightshift.example" for v, _ in got)


def test_one_method_per_address(records):
    methods = contacts.methods_from_pages(records, KEY)
    folded = contacts.fold_methods(methods, ["url", "position"])
    assert folded.filter("preview = 'de•••@nightshift.example'").count() == 1


@pytest.fixture(scope="module")
def funnel(spark, records):
    none = F.array().cast("array<string>")
    campaigns = spark.range(1).select(F.lit(1).alias("campaign_id"), F.lit(1).alias("tenant_id")).withColumns({
        "mode": F.lit("COPILOT"), "territories": F.array(F.lit("US")), "primary_genre": F.lit("techno"), "secondary_genres": none,
        "microgenres": F.array(F.lit("dark electronic")), "mood": F.array(F.lit("dark")), "playlist_contexts": none, "sender_ready": F.lit(True)})
    out = discovery.discover(
        records, campaigns, spark.createDataFrame([], "tenant_id int, value_hash string, scope string, reason string"),
        spark.createDataFrame([], "tenant_id int, contact_id string, outlet_id string, accepted_count int, declined_count int, placement_count int"),
        spark.createDataFrame([], "tenant_id int, artist_id string, outlet_id string, domain string"), KEY, AS_OF)
    return {r["url"]: r for r in out.collect()}


def test_funnel_statuses(funnel):
    assert "https://check.example/" not in funnel and "https://open.spotify.com/x" not in funnel
    assert funnel["https://sold.example/"]["status"] == "BLOCKED"
    assert funnel["https://sold.example/"]["rejection_reason"] == "Suspicious route"
    assert funnel["https://shut.example/"]["status"] == "DISQUALIFIED"
    assert funnel["https://nightshift.example/submit"]["status"] == "READY"
    assert funnel["https://wall.example/"]["route_method"] == "LOGIN_REQUIRED"
    assert funnel["https://robot.example/"]["route_method"] == "WEB_FORM"
    assert funnel["https://person.example/"]["decision"] in ("DRAFT_ONLY", "BLOCK")


def test_one_inbox_is_one_target(funnel):
    twin = funnel["https://nightshift.example/about"]
    assert twin["status"] == "DUPLICATE" and twin["owner_id"] == funnel["https://nightshift.example/submit"]["outlet_id"]
    assert funnel["https://nightshift.example/submit"]["members"] == 2


def test_unknown_components_are_named(funnel):
    texts = [r["text"] for r in funnel["https://nightshift.example/submit"]["reasons"]]
    assert "Target territory match unverified" in texts


def test_owner_is_the_earliest_row(spark):
    rows = [("c", "k", i, f"o{i}") for i in range(50, 0, -1)]
    out = entities.owners(spark.createDataFrame(rows, "c string, k string, seq int, id string").repartition(5), ["c", "k"], "id", ["seq"])
    assert {r["owner_id"] for r in out.collect()} == {"o1"} and out.filter("NOT is_duplicate").count() == 1


def test_long_pages_are_read_whole(spark):
    body = "<p>" + "word " * 200_000 + "final playlist here</p>"
    df = spark.createDataFrame([("https://long.example/", page("Long", body))], "url string, html string")
    r = page_facts.page_records(df).select("classification.label", F.length("visible_text").alias("n")).first()
    assert r["label"] == "PLAYLIST" and r["n"] > 1_000_000


def test_evidence_and_documents(records, spark):
    refused = spark.createDataFrame([(1, "http://localhost/", "BLOCKED_HOSTNAME")], "tenant_id int, url string, block_reason string")
    docs = page_facts.source_documents(records, refused, AS_OF)
    assert docs.filter("fetch_status = 'BLOCKED'").first()["block_reason"] == "BLOCKED_HOSTNAME"
    assert docs.filter("length(sanitized_text) > 2001").count() == 0
    facts = page_facts.provenance(page_facts.evidence_packets(records, "domain", "outlet", AS_OF), AS_OF)
    night = [r for r in facts.collect() if r["entity_id"] == "nightshift.example"]
    assert {r["supports_field"] for r in night} == {"classification", "submissions_open"} and all(r["corroborating_domains"] == 1 for r in night)


def test_slices_of_a_batch_are_bounded_and_hold_every_row(spark):
    from wayfold.sources import markup, pages
    sizes = [10] * 1234 + [markup.CHARACTERS * 2, 0, markup.CHARACTERS, 1] + [markup.CHARACTERS // 3] * 10
    parts = list(markup.slices(sizes))
    assert [i for p in parts for i in range(len(sizes))[p]] == list(range(len(sizes))) and list(markup.slices([])) == []
    for p in parts:
        assert p.stop - p.start <= markup.ROWS and (sum(sizes[p]) <= markup.CHARACTERS or p.stop - p.start == 1)
    df = spark.createDataFrame([(i, f"https://a{i}.example/", f"<title>T {i}</title>" if i % 7 else None) for i in range(1100)], "k long, url string, html string").coalesce(1)
    got = {r["k"]: r["title"] for r in pages.read_pages(df).select("k", "title").collect()}
    assert got == {i: f"T {i}" if i % 7 else None for i in range(1100)}


def test_ids_beside_nulls_stay_whole_and_a_filter_reads_no_page_again(spark):
    from wayfold.sources import pages
    rows = [(2 ** 53 + 1, "https://a.example/", "<title>A</title>"), (None, "https://b.example/", "<title>B</title>"), (7, None, None)]
    read = pages.read_pages(spark.createDataFrame(rows, "k long, url string, html string").coalesce(1))
    assert {(r["k"], r["title"]) for r in read.collect()} == {(2 ** 53 + 1, "A"), (None, "B"), (7, None)}
    plan = read.filter("title = 'A'").select("k", "title", "links")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_own_links_are_picked_once(spark):
    df = spark.createDataFrame([("https://a.example/", "<a href='/terms'>T</a><a href='https://b.org/about'>x</a><a href='/about'>A</a>")], "url string, html string")
    out = page_facts.with_declared_links(page_facts.page_records(df)).select("declared.*")
    assert out.first().asDict() == {"terms_url": "https://a.example/terms", "privacy_url": None, "pricing_url": None, "submission_url": None,
                                    "contact_url": "https://a.example/about"}
    plan = page_facts.with_declared_links(df.selectExpr("url AS domain", "array(struct(url AS href, html AS raw_href, html AS text)) AS links")).select(
        "declared.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https?://") == 1
