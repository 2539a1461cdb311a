import pytest
from pyspark.sql import functions as F

from wayfold.functions import passages, text
from wayfold.functions import score as sc
from wayfold.plans import contacts, entities, outreach, page_facts, promotion, reporting, scoring

AS_OF = "2024-03-01 00:00:00"
BASE = {
    "has_method": True, "restricted_only": False, "contact_category": "ROLE_BASED_ADDRESS", "suppression_reason": None, "sendable": True, "blockers": [],
    "risk_band": "LOW RISK", "risk_score": 0, "cost_model": "FREE_SUBMISSION", "accepted_count": 0, "placement_count": 0, "territory": "US",
    "contact_domain": "x.example", "outlet_domain": "x.example", "sender_ready": True, "mode": "COPILOT", "send_stop": False,
}
TYPES = {bool: "boolean", int: "int", str: "string", list: "array<string>", type(None): "string"}


def decide(spark, **changes):
    row = {**BASE, **changes}
    schema = ", ".join(f"{k} {TYPES[type(BASE[k])] if v is None else TYPES[type(v)]}" for k, v in row.items())
    return scoring.decide(spark.createDataFrame([tuple(row.values())], schema)).first()


@pytest.mark.parametrize("changes,decision", [
    ({}, "APPROVAL_REQUIRED"), ({"has_method": False}, "DRAFT_ONLY"), ({"contact_category": "PERSONAL_ADDRESS"}, "BLOCK"),
    ({"suppression_reason": "Opt-out"}, "BLOCK"), ({"restricted_only": True}, "BLOCK"), ({"risk_band": "HIGH RISK", "risk_score": 60}, "LEGAL_REVIEW"),
    ({"risk_band": "BLOCK", "risk_score": 90}, "BLOCK"), ({"cost_model": "GUARANTEED_STREAMS"}, "BLOCK"),
    ({"cost_model": "ADVERTISING_OR_SPONSORSHIP"}, "LEGAL_REVIEW"), ({"mode": "SCOUT"}, "DRAFT_ONLY"), ({"sender_ready": False}, "DRAFT_ONLY"),
    ({"sendable": False, "blockers": ["no"]}, "DRAFT_ONLY"), ({"send_stop": True}, "BLOCK"),
])
def test_decisions(spark, changes, decision):
    assert decide(spark, **changes)["decision"] == decision


def test_reasons_never_cancel_and_stop_stands_alone(spark):
    r = decide(spark, mode="SCOUT", risk_band="HIGH RISK", risk_score=60, cost_model="PAID_CONSIDERATION", territory=None, contact_domain="a.example")
    assert r["decision"] == "LEGAL_REVIEW" and len(r["decision_reasons"]) == 4 and r["recipient_country"] is None
    assert decide(spark, send_stop=True, mode="SCOUT")["decision_reasons"] == ["Emergency send stop is engaged"]
    blocked = decide(spark, contact_category="PERSONAL_ADDRESS", sendable=False, blockers=["Contact category"])
    assert "Contact category" not in blocked["decision_reasons"]
    assert decide(spark, territory="FR")["lawful_basis"].startswith("GDPR")


def test_contact_ladder(one):
    def category(value, page="UNKNOWN", origin="visible-text", independent=1, hidden=False, official=False, provider="web"):
        return one(contacts.classify_contact(F.lit(value), F.lit(page), F.lit(provider), F.lit(origin), F.lit(independent), F.lit(hidden), F.lit(official)))["category"]
    assert category("nobody") == "UNKNOWN"
    assert category("demo@x.example", provider="spotify") == "SPOTIFY_ONLY_SOURCE"
    assert category("demo@x.example", hidden=True) == "PROHIBITED_PRIVATE_INFORMATION"
    assert category("a.b@gmail.com") == "PERSONAL_ADDRESS" and category("demo@gmail.com") == "ROLE_BASED_ADDRESS"
    assert category("zoe@x.example", "SUBMISSION_GUIDELINES") == "EXPLICIT_SUBMISSION_ROUTE"
    assert category("demo@x.example", official=True) == "VERIFIED_PUBLIC_BUSINESS"
    assert category("zoe@x.example", "RADIO") == "UNVERIFIED_PUBLIC_BUSINESS"
    assert category("zoe@x.example", "RADIO", independent=2) == "VERIFIED_PUBLIC_BUSINESS"
    assert category("zoe@x.example") == "UNKNOWN"


def test_sendability_lists_every_blocker(frame):
    m = frame([("t", "h", "WEB_FORM", "PERSONAL_ADDRESS", True, 1)],
              "tenant_id string, value_hash string, kind string, category string, restricted_only boolean, independent_domains int")
    reg = frame([("h", "GLOBAL", None, "Opt-out")], "value_hash string, scope string, tenant_id string, reason string")
    r = contacts.sendability(m, reg).first()
    assert len(r["blockers"]) == 4 and r["sendable"] is False


def test_risk_of_a_page(frame):
    df = frame([(("GUARANTEED_PLACEMENT", "buy streams overnight"), "t", ("PAID_CONSIDERATION", None), ["x"], ["h@x.example"], ("UNKNOWN",), "d.example", "d.example", ("2020",))],
               "classification struct<label:string,excerpt:string>, title string, cost struct<model:string,amount:double>, injection_findings array<string>, hidden_emails array<string>, "
               "submissions struct<state:string>, outlet_name string, domain string, freshness struct<date:string>")
    r = scoring.assess_risk(df, AS_OF).first()
    assert r["risk_signals"] == ["artificial_streaming_language", "guaranteed_placement", "honeypot_contact", "injection_attempt", "missing_submission_terms",
                                 "stale_presence", "unclear_ownership", "unexplained_payment", "unrealistic_claims"]
    assert r["risk_score"] == 100 and r["risk_band"] == "BLOCK"


def test_reasons_are_ordered_by_weight_and_capped(one):
    from wayfold import rules
    comps = {name: F.lit(None).cast("double") for name, *_ in rules.OPPORTUNITY_COMPONENTS}
    got = one(sc.opportunity_reasons(comps))
    assert len(got) == 8 and got[0]["text"] == "Genre match unverified" and got[2]["text"] == "Explicit submission route unverified"


def test_override_row_wins(frame):
    from wayfold.operators.latest import newest_per_key
    scores = frame([("t", 20, 1, 1)], "target_id string, score int, created_at int, seq int")
    manual = frame([("t", 90, 1, 2, "heard it"), ("t", 95, 1, 3, " "), ("t", 300, 1, 4, "too high")], "target_id string, score int, created_at int, seq int, reason string")
    log = scoring.score_overrides(scores, manual)
    assert newest_per_key(log, ["target_id"], ["created_at", "seq"]).first()["score"] == 90


# -- paid services -----------------------------------------------------------

def packets(spark, rows):
    fields = promotion.VALUE.replace(" ", ":").replace(",:", ",")
    names = [p.split(" ")[0] for p in promotion.VALUE.split(", ")]
    data = [(s, f, tuple(v.get(n) for n in names), "passage", c, url, "h", 1, i) for i, (s, f, v, c, url) in enumerate(rows)]
    df = spark.createDataFrame(data, f"service_id string, supports_field string, value struct<{fields}>, excerpt string, confidence double, source_url string, content_hash string, "
                                     "day int, seq int")
    return df.withColumn("retrieved_at", F.lit("2024-02-28").cast("timestamp")).repartition(3)


def screen(spark, rows, **kw):
    services = spark.createDataFrame([("s", "Svc", "svc.example", "UNKNOWN")], "service_id string, name string, canonical_domain string, screening_status string")
    counts = spark.createDataFrame([("s", kw.get("pages", 2))], "service_id string, page_ok_count int")
    return promotion.screen_services(packets(spark, rows), services, counts, kw.get("policy_stale", False), AS_OF).first()


GOOD = [
    ("s", "business_model", {"category": "INDIVIDUAL_CURATOR", "service_types": ["CURATOR_SUBMISSIONS"], "genres": ["techno"]}, 0.6, "u1"),
    ("s", "pricing", {"min": 5.0, "max": 12.0, "currency": "USD", "model": "PAID_CONSIDERATION"}, 0.7, "u1"),
    ("s", "placement_policy", {"field": "placement_discretionary", "value": True}, 0.7, "u1"),
    ("s", "refund_policy", {"field": "refund_policy", "value": True}, 0.7, "u2"),
    ("s", "terms", {"terms_url": "https://svc.example/terms"}, 0.6, "u2"),
]


def test_full_evidence_is_screened(spark):
    r = screen(spark, GOOD)
    assert r["status"] == "SCREENED" and r["score"] == 100 and r["coverage"] >= 50


def test_a_signal_blocks_whatever_else_holds(spark):
    r = screen(spark, GOOD + [("s", "stream_guarantees", {"signal": "bot_engagement", "label": "Bot or artificial engagement"}, 0.9, "u3")])
    assert r["status"] == "BLOCKED" and r["block_reason"].startswith("Bot or artificial engagement")


def test_missing_evidence_is_unknown_not_safe(spark):
    r = screen(spark, [GOOD[0], GOOD[2]], pages=1)
    assert r["status"] == "UNKNOWN" and r["score"] is None
    assert r["reasons"] == ["pricing unavailable", "no terms or contact page found", "fewer than two pages of this service could be read"]
    walled = screen(spark, [GOOD[0], GOOD[2], ("s", "pricing", {"login_walled": True}, 0.7, "u1")])
    assert "pricing is behind a login — login-walled pages are not read" in walled["reasons"]


def test_cautions(spark):
    platform = [("s", "business_model", {"category": "PLATFORM"}, 0.6, "u1"), *GOOD[1:]]
    assert screen(spark, platform)["status"] == "CAUTION"
    paid = screen(spark, GOOD + [("s", "curator_compensation", {"field": "curator_compensation", "value": True}, 0.7, "u1")])
    assert paid["reasons"] == ["Curators are paid per placement"]
    assert screen(spark, GOOD, policy_stale=True)["status"] == "CAUTION"


def test_conflict_leaves_the_field_unknown_and_flags_review(spark):
    rows = GOOD + [("s", "curator_compensation", {"field": "curator_compensation", "value": v}, 0.7, f"u{v}") for v in (True, False)]
    facts = promotion.recompute_facts(packets(spark, rows)).first()
    assert facts["curator_compensation"] is None and facts["manual_review_required"] is True
    assert facts["business_model_summary"] == ("An individual curator reviewing submissions directly. Published prices run 5–12 USD. "
                                               "Placement stays at the curator's discretion.")


def test_commercial_columns_never_enter_screening(spark):
    df = spark.createDataFrame([("s", "PARTNER", "paid us")], "service_id string, relation string, disclosure string")
    seen = promotion.screening_inputs(df)
    assert seen.columns == ["service_id"]


SIGNALS = [
    ("Our packages: $20. We guarantee 10,000 streams.", ["guaranteed_streams"]), ("Our packages: $20. We never guarantee streams.", []),
    ("We guarantee streams.", []), ("Pricing: $30 for 5,000 plays", ["stream_quantity_pricing"]),
    ("Plans from $5. Beware of services that use bots", []), ("Plans from $5. We do not sell plays. Our bots listen.", ["bot_engagement"]),
    ("Plans from $5. Never use bots! They guarantee saves", ["guaranteed_saves"]),
    ("Plans from $5. No bots, never bots.\nbots", ["bot_engagement"]),
    ("Plans from $5. We never " + "really " * 12 + "guarantee streams", []), ("Plans from $5. We never " + "really " * 13 + "guarantee streams", ["guaranteed_streams"]),
    ("Guaranteed 100,000 impressions. Ad packages from $500", []),
    ("Plans from $5. Buy 1,000 plays. Placement is guaranteed. We guarantee streams. Order 50 saves", ["guaranteed_streams", "guaranteed_placement", "guaranteed_saves"]),
    ("", []), (None, []), ("bots " * 3000 + "$5", ["bot_engagement"]), ("no bots. " * 2000 + "$5", []),
]


def test_guarded_signals(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SIGNALS)], "i int, t string")
    plain, folded = (passages.block_signals(F.col("t"), f) for f in (None, text.fold("t")))
    for r in df.select("i", "t", plain.alias("s"), folded.alias("f")).collect():
        wanted = SIGNALS[r["i"]][1]
        if r["t"] is not None:
            assert [x["signal"] for x in r["s"]] == wanted and r["s"] == r["f"], r["t"][:80]
            assert all(" ".join(x["excerpt"].strip("…").split()) in " ".join(r["t"].split()) for x in r["s"])


def test_places_count_code_points(spark):
    df = spark.createDataFrame([("𝄞𝄞 É bots and bots",)], "t string")
    place = passages.first_place(F.col("t"), r"\bbots\b")
    got = df.select(place.alias("p"), passages.around(F.col("t"), place, 10).alias("x"),
                    passages.fold_matches(F.col("t"), r"\bbots\b", F.lit(0), lambda n, p, hit: n + p["start"], lambda n: n).alias("n"),
                    passages.first_place(F.col("t"), "none").alias("none")).first()
    assert (got["p"]["start"], got["p"]["end"], got["x"], got["n"], got["none"]) == (5, 9, "𝄞𝄞 É bots and…", 5 + 14, None)


FACTS = [
    ("", "Refund policy: ask us", {"refund_policy": True}), ("", "There is no refund policy", {}),
    ("Refund policy", "There is no refund policy", {"refund_policy": True}), ("No refund policy", "Our refund terms", {"refund_policy": True}),
    ("", "Curators are never paid. Curators are paid for placement", {"curator_compensation": True}),
    ("", "Curators are never paid", {"curator_compensation": False}),
    ("", "We do not buy streams. Refund policy: refunded in full. Bot-free", {"refund_policy": True, "anti_bot_policy": True}),
    ("", "We don't have a refund policy. Refund terms follow", {}),  # the first match alone decides
    (None, None, {}),
]


def test_stated_facts(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(FACTS)], "i int, a string, b string")
    for r in df.select("i", passages.stated_facts(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))).alias("f")).collect():
        assert {x["field"]: x["value"] for x in r["f"]} == FACTS[r["i"]][2], FACTS[r["i"]]


PRICES = [
    ("We won $1,000,000 in a lottery last year.", None), ("Packages: $1,250.50 or 300 EUR", ("PAID_CONSIDERATION", 300.0, 1250.5, "USD")),
    ("It is free to submit", ("FREE_SUBMISSION", 0.0, 0.0, None)), ("Free to submit, priority costs 9 usd", ("PAID_CONSIDERATION", 9.0, 9.0, "USD")),
    ("Prices from €5" + " word" * 30 + " $700", ("PAID_CONSIDERATION", 5.0, 5.0, "EUR")),
    ("price" + "x" * 80 + " £3", None), ("price " + "x" * 82 + " £3", ("PAID_CONSIDERATION", 3.0, 3.0, "GBP")),
    ("price " + "x" * 86 + " £3", None), ("", None), (None, None), ("$5 fee " * 2000, ("PAID_CONSIDERATION", 5.0, 5.0, "USD")),
]


def test_prices_need_a_pricing_context(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PRICES)], "i int, t string")
    for r in df.select("i", passages.stated_prices(F.col("t")).alias("p")).collect():
        assert (r["p"] and tuple(r["p"])[:4]) == PRICES[r["i"]][1], PRICES[r["i"]][0][:60]


def test_login_wall_on_the_pricing_page_needs_no_price_word(one):
    wall = lambda **c: one(page_facts.price_login_wall(F.col("w"), F.col("t"), F.col("l"), F.col("u"), F.col("p")), **c)
    page = {"w": "Title members only", "t": "members only", "l": True}
    assert wall(**page, u="https://a/pricing", p="https://a/pricing") == "members only"
    assert wall(**page, u="https://a/", p="https://a/pricing") is None and wall(**page, u="https://a/", p="") is None
    assert wall(w="Title our rates are inside", t="x", l=True, u="https://a/", p="").startswith("Title our rates")
    assert wall(w="Title our rates", t="x", l=False, u="u", p="u") is None


def test_plan_totals_keep_unknown_apart(frame):
    items = frame([("c", 10.0, "PAID", "x"), ("c", None, "PLANNED", None), ("c", 7.0, "DECLINED", "x"), ("c", 5.0, "PLANNED", None), ("c", 3.0, "REFUNDED", None), ("n", 1.0, "PLANNED", None)],
                  "campaign_id string, amount double, status string, paid_at string")
    camps = frame([("c", 100.0), ("n", None), ("e", 5.0)], "campaign_id string, promotion_budget double")
    got = {r["campaign_id"]: (r["spent"], r["planned"], r["unknown_amounts"], r["remaining"]) for r in promotion.plan_totals(items, camps).collect()}
    assert got == {"c": (17.0, 5.0, 1, 78.0), "n": (0.0, 1.0, 0, None), "e": (0.0, 0.0, 0, 5.0)}


def test_fit_pairs_leave_out_blocked_dismissed_and_scored(frame):
    camps = frame([("t", "c")], "tenant_id string, campaign_id string")
    svc = frame([("t", "a", None), ("t", "b", "BLOCKED"), ("t", "d", "SCREENED"), ("u", "e", None), ("t", "f", None)], "tenant_id string, service_id string, screening_status string")
    gone = frame([("c", "d")], "campaign_id string, service_id string")
    done = frame([("c", "f")], "campaign_id string, service_id string")
    assert {r["service_id"] for r in promotion.fit_pairs(camps, svc, gone, done).collect()} == {"a"}


def test_blocked_services_cannot_be_planned(frame):
    items = frame([("i1", "a"), ("i2", "b"), ("i3", None)], "item_id string, service_id string")
    svc = frame([("a", "BLOCKED"), ("b", "CAUTION")], "service_id string, screening_status string")
    assert {r["item_id"] for r in promotion.addable(items, svc).collect()} == {"i2", "i3"}


# -- outreach ----------------------------------------------------------------

def test_one_forbidden_source_refuses_the_group(frame):
    g = frame([("a", "web"), ("a", "own"), ("b", "own"), ("b", "video"), ("c", "nowhere")], "k string, source string")
    p = frame([("web", True), ("own", True), ("video", False)], "source string, ok boolean")
    got = {r["k"]: (r["allowed"], r["blocked_sources"]) for r in outreach.guard_sources(g, p, ["k"], "ok").collect()}
    assert got == {"a": (True, []), "b": (False, ["video"]), "c": (False, ["unregistered"])}


def test_warmup_cooldown_and_gate(frame):
    sends = frame([("t", "x1", "2024-02-28 12:00:00", "EMAIL", "SENT"), ("u", "x2", "2023-01-01 00:00:00", "EMAIL", "BOUNCED")],
                  "tenant_id string, target_id string, at string, method string, status string").withColumn("sent_at", F.col("at").cast("timestamp"))
    caps = {r["tenant_id"]: r["warmup_cap"] for r in outreach.warmup_caps(sends, AS_OF).collect()}
    assert caps == {"t": 20, "u": 500}
    targets = frame([("x1", "c1"), ("x2", "c2")], "target_id string, contact_id string")
    cool = {r["contact_id"]: r["cooldown_days"] for r in outreach.cooldowns(sends, targets, AS_OF).collect()}
    assert cool == {"c1": 28, "c2": None}
    assert {r["tenant_id"]: r["bounce_rate"] for r in outreach.bounce_rates(sends).collect()} == {"t": 0.0, "u": 1.0}


def test_send_counts_include_the_edge_of_the_day(frame):
    sends = frame([("2024-02-29 00:00:00",), ("2024-02-28 23:59:59",)], "at string").select(F.lit("t").alias("tenant_id"), F.lit("EMAIL").alias("method"), F.col("at").cast("timestamp").alias("sent_at"))
    assert outreach.sent_counts(sends, ["tenant_id"], AS_OF).first()["sent_today"] == 1


def test_opt_out_in_a_reply(frame):
    df = frame([("REPLY", "please UNSUBSCRIBE me"), ("REPLY", "thanks"), ("DECLINE", "unsubscribe")], "kind string, body string")
    assert [(r["kind"], r["sentiment"]) for r in outreach.responses_with_kind(df).collect()] == [("OPT_OUT", "NEGATIVE"), ("REPLY", "NEUTRAL"), ("DECLINE", "NEGATIVE")]


def test_follow_ups_stop_with_any_response(frame):
    sends = frame([("a", "2024-02-01"), ("b", "2024-02-01"), ("c", "2024-02-20")], "k string, d string").withColumn("ts", F.col("d").cast("timestamp"))
    resp = frame([("a", "2024-02-03"), ("b", "2024-01-01")], "k string, d string").withColumn("ts", F.col("d").cast("timestamp"))
    assert [r["k"] for r in outreach.follow_ups_due(sends, resp, ["k"], AS_OF).collect()] == ["b"]


def test_task_effects(frame):
    tasks = frame([("k1", "t1", "r1", "p", 0.0), ("k2", None, "r2", "p", 0.0)], "task_id string, target_id string, route_id string, provider string, cost double")
    events = frame([("k1", "SUBMITTED", 1), ("k1", "BROKEN_ROUTE", 2), ("k2", "SUBMITTED", 3)], "task_id string, status string, ts int")
    sent, broken = outreach.task_effects(events, tasks)
    assert [r["target_id"] for r in sent.collect()] == ["t1"] and [r["route_id"] for r in broken.collect()] == ["r1"]


# -- reports -----------------------------------------------------------------

def test_empty_stages_stay(frame):
    out = reporting.stage_counts(frame([("c", "READY")], "campaign_id string, status string"), frame([("c",), ("d",)], "campaign_id string"))
    assert out.count() == 14 and out.agg(F.sum("targets")).first()[0] == 1


def test_placement_value_measures_only_what_is_known(frame):
    places = frame([("p", 10.0), ("q", 0.0)], "placement_id string, cost double").withColumns({"added_date": F.lit(None).cast("date"), "removed_date": F.lit(None).cast("date")})
    out = frame([("p", "saves", 500.0, 1, 1), ("p", "saves", 800.0, 1, 2), ("p", "follows", 0.0, 1, 3)], "placement_id string, metric string, value double, captured_at int, seq int")
    got = {r["placement_id"]: (r["score"], r["state"], r["cost_per_point"]) for r in reporting.placement_value(places, out, AS_OF).collect()}
    assert got == {"p": (80, "MEASURED", 0.12), "q": (None, "UNMEASURED", None)}  # the measured zero is left out


def test_attribution_states(frame):
    camps = frame([("a",), ("b",)], "campaign_id string")
    snaps = frame([("a", "streams", "BASELINE", 10.0, 1, 1), ("a", "streams", "BASELINE", 99.0, 2, 2), ("a", "streams", "OUTCOME", 15.0, 3, 3), ("b", "streams", "BASELINE", 1.0, 1, 1)],
                  "campaign_id string, metric string, kind string, value double, captured_at int, seq int")
    got = {(r["campaign_id"], r["metric"]): (r["state"], r["delta"]) for r in reporting.attribution(camps, snaps).collect()}
    assert got[("a", "streams")] == ("MEASURED", 5.0) and got[("b", "streams")] == ("NO_OUTCOME", None) and got[("a", "total_earned")] == ("NO_BASELINE", None)


def test_route_merges_and_suggestions(frame):
    outlets = frame([("t", i, f"www{i % 2}.site.example", None) for i in range(4)], "tenant_id string, outlet_id int, domain string, canonical_id string")
    routes = frame([("t", i, "EMAIL", True, "demo@site.example" if i < 3 else "other@site.example") for i in range(4)],
                   "tenant_id string, outlet_id int, method string, active boolean, destination string")
    assert sorted((r["winner_id"], r["loser_id"]) for r in entities.route_merges(routes, outlets).collect()) == [(0, 1), (0, 2)]
    names = frame([("t", 1, "Café – Noir"), ("t", 2, "café noir!"), ("t", 3, "!!!"), ("t", 4, "???")], "tenant_id string, id int, name string")
    assert sorted(r["id"] for r in entities.name_suggestions(names, ["tenant_id"], "id", "name").collect()) == [1, 2]


def test_stop_rules(frame):
    rows = frame([("a", 30, 20, 5, 0, "ACTIVE"), ("b", 30, 0, 1, 0, "ACTIVE"), ("c", 30, 0, 30, 24, "ACTIVE"), ("d", 5, 5, 0, 0, "ACTIVE"), ("e", 0, 0, 0, 0, "CANCELLED")],
                 "campaign_id string, total int, duplicates int, qualified int, searches_used int, campaign_status string").withColumn("search_budget", F.lit(24))
    got = {r["campaign_id"]: r["stop_reason"] for r in reporting.stop_reason(rows).collect()}
    assert got == {"a": "Duplicate rate 67% — diminishing returns", "b": "Qualified yield 3% — diminishing returns", "c": "Search budget reached (24/24)", "d": None,
                   "e": "Campaign cancelled by user"}


def test_service_list_is_dealt_by_its_keys(spark):
    from wayfold.session import PART_ROWS, parts_for
    assert parts_for(spark, 1000 * PART_ROWS + 1) == 1001 and parts_for(spark, 0) == spark.sparkContext.defaultParallelism
    df = spark.createDataFrame([(1, 1, "SCREENED", "b", 5, 0), (1, 2, "BLOCKED", "a", 9, 0), (1, 3, "SCREENED", "c", None, 0), (1, 1, "SCREENED", "b", 7, 1)],
                               "campaign_id int, service_id int, screening_status string, name string, fit_score int, seq int")
    log = df.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    pairs = df.filter("seq = 0").drop("fit_score").withColumns({c: F.lit(None).cast("timestamp") for c in ("next_review_at", "last_screened_at", "pricing_last_verified_at")}) \
        .withColumns({"pricing_min": F.lit(1.0), "service_types": F.array(F.lit("PRESS_PR"))})
    out = promotion.campaign_services(pairs, log, "all", "2024-03-01 00:00:00", 37)
    assert [(r["service_id"], r["fit_score"]) for r in out.collect()] == [(1, 7), (3, None), (2, None)]
    assert out._jdf.queryExecution().executedPlan().toString().count("service_id#") and "37), REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
