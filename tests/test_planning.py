from pyspark.sql import functions as F

from wayfold import rules
from wayfold.plans import planning


def interleave(families, budget):
    """Plain reading of the rule: families by name, one query of each in turn."""
    queues = [list(q) for _, q in sorted(families.items())]
    out = []
    while any(queues) and len(out) < budget:
        for q in queues:
            if q and len(out) < budget:
                out.append(q.pop(0))
    return out


def collect(pairs):
    families, seen = {}, set()
    for family, query in pairs:
        query = " ".join(query.split())
        if query and query.lower() not in seen:
            seen.add(query.lower())
            families.setdefault(family, []).append(query)
    return families


def test_campaign_queries_equal_a_plain_reading(spark):
    genres, micros = ["techno", "House", "rock"], ["dark electronic", "ebm", "Techno"]
    channels, lands, artists, formats = ["RADIO", "PLAYLIST", "NOPE"], ["DE", "us"], ["Ana", "Bo", "Cy", "Di"], ["college", "AAA", "x"]
    pairs = []
    for c in channels:
        for t in rules.CHANNEL_TEMPLATES.get(c, []):
            pairs += [(c, t.format(genre=g, microgenre=g)) for g in genres[:2] + micros[:3]]
    for a in artists[:3]:
        pairs += [("COMPARABLE", f"playlists featuring {a}"), ("COMPARABLE", f"{a} similar artists submissions")]
    pairs.append(("SCENE", "club scene submit music"))
    pairs += [("RADIO", f"{f} radio format submissions") for f in formats[:2]]
    for t in lands:
        pairs += [("LOCAL_LANGUAGE", tpl.format(genre=micros[0])) for tpl in rules.LANGUAGE_TEMPLATES.get(t.upper(), [])]
        pairs.append(("TERRITORY", f"{t} {micros[0]} playlist curator"))
    df = spark.createDataFrame([("c", channels, lands, genres, micros, artists, "club", formats)],
                               "campaign_id string, channels array<string>, territories array<string>, genres array<string>, microgenres array<string>, "
                               "comparable_artists array<string>, scene string, radio_formats array<string>")
    for budget in (5, 24, 500):
        got = [r["query"] for r in planning.campaign_queries(df, budget).orderBy("position").collect()]
        assert got == interleave(collect(pairs), budget)


def test_a_missing_field_gives_no_query(spark):
    df = spark.createDataFrame([("c", ["BLOG"], [], [], [], [], None, [])],
                               "campaign_id string, channels array<string>, territories array<string>, genres array<string>, microgenres array<string>, "
                               "comparable_artists array<string>, scene string, radio_formats array<string>")
    assert planning.campaign_queries(df).count() == 0


def test_promotion_queries_equal_a_plain_reading(spark):
    genres, micros, lands = ["techno", "house", "x"], ["ebm", "idm", "y"], ["DE", "US"]
    pairs = []
    for family, templates in rules.PROMOTION_TEMPLATES.items():
        for t in templates:
            pairs += [(family, t.format(genre=g, microgenre=g, territory=lands[0])) for g in genres[:2] + micros[:2]]
    pairs += [("SEED", f'"{n}" pricing submission terms') for n in rules.SEED_SERVICES]
    df = spark.createDataFrame([(1, genres, micros, lands)], "tenant_id int, genres array<string>, microgenres array<string>, territories array<string>")
    got = [r["query"] for r in planning.promotion_queries(df).orderBy("position").collect()]
    assert got == interleave(collect(pairs), 40) and len(got) == 40


def test_watch_list_cap_and_case(spark):
    names = [("t", f"Name {i}", i) for i in range(21)] + [("t", "name 3", 50), ("t", "  ", 51), ("u", "A" * 121, 1)]
    out = planning.watch_list(spark.createDataFrame(names, "tenant_id string, name string, seq int"))
    assert out.count() == 20 and out.agg(F.max("seq")).first()[0] == 19


def test_fetch_list_reports_every_refusal(spark):
    rows = [("c", i, f"https://a.example/{i}") for i in range(12)] + [("c", 20, "http://localhost/"), ("c", 21, "https://www.youtube.com/x")]
    got = {r["seq"]: r["reason"] for r in planning.fetch_list(spark.createDataFrame(rows, "campaign_id string, seq int, url string")).collect()}
    assert len(got) == 14 and [got[i] for i in range(8)] == [None] * 8 and got[8] == "DOMAIN_BUDGET"
    assert got[20] == "BLOCKED_HOSTNAME" and got[21] == "PLATFORM_DOMAIN"


def test_plans_need_no_shuffle_of_queries_and_repeated_keys_share_one(spark):
    schema = ("campaign_id string, channels array<string>, territories array<string>, genres array<string>, microgenres array<string>, "
              "comparable_artists array<string>, scene string, radio_formats array<string>")
    row = lambda k, artists: (k, ["PLAYLIST", "BLOG"], ["DE"], ["techno"], ["ebm"], artists, "club", ["college"])
    rows = [row("a", ["Ana"]), row("b", ["Bo"]), row("b", ["Cy", "bo"]), row("b", ["Bo"]), row(None, ["Di"]), row(None, ["Ed"])]
    df = spark.createDataFrame(rows, schema)
    out = planning.campaign_queries(df, 500)
    together = planning._interleaved_together
    planning._interleaved_alone, kept = together, planning._interleaved_alone
    try:
        expected = planning.campaign_queries(df, 500)
        assert out.schema.simpleString().count("place") == 1
        assert sorted(map(str, out.select(*sorted(out.columns)).collect())) == sorted(map(str, expected.select(*sorted(out.columns)).collect()))
    finally:
        planning._interleaved_alone = kept
    plan = planning._interleaved_alone(df.limit(1).selectExpr("campaign_id", "array(named_struct('family', 'F', 'query', 'q', 'territory', '', 'language', 'en')) AS plan"), ["campaign_id"], 3)
    assert "hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    keyed = [r for r in out.collect() if r["campaign_id"] == "b"]
    assert len({r["query"].lower() for r in keyed}) == len(keyed) and {r["position"] for r in keyed} == set(range(1, len(keyed) + 1))
