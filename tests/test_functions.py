import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import keys, score, text, web, when


@pytest.mark.parametrize("host,expected", [
    ("a.b.example.com", "example.com"), ("shop.band.co.uk", "band.co.uk"), ("co.uk", "co.uk"), ("example.com.", "example.com"), ("", ""),
])
def test_registrable_domain(one, host, expected):
    assert one(web.registrable_domain("h"), h=host) == expected


@pytest.mark.parametrize("url,reason", [
    ("https://a.example/x", None), ("ftp://a.example/x", "BLOCKED_SCHEME"), ("javascript:alert(1)", "BLOCKED_SCHEME"),
    ("http://localhost/", "BLOCKED_HOSTNAME"), ("http://db.internal/", "BLOCKED_HOSTNAME"), ("http://169.254.169.254/", "BLOCKED_METADATA_ENDPOINT"),
    ("http://127.0.0.1/", "BLOCKED_PRIVATE_IP"), ("http://172.20.1.1/", "BLOCKED_PRIVATE_IP"), ("http://172.33.1.1/", None),
    ("http://[::1]/", "BLOCKED_PRIVATE_IP"), ("http://a.example:22/", "BLOCKED_PORT"), ("http://a.example:8080/", None),
    ("http://a.example/f.ZIP?x=1", "BLOCKED_FILE_TYPE"), ("http://user@a.example/f", None), ("http:///nohost", "BLOCKED_HOSTNAME"),
])
def test_url_admission(one, url, reason):
    assert one(web.block_reason("u"), u=url) == reason


def test_same_domain_needs_both_sides(one):
    assert one(web.same_domain("e", "d"), e="x@mail.site.example", d="www.site.example") is True
    assert one(web.same_domain("e", "d"), e="none", d="site.example") is False


@pytest.mark.parametrize("raw,norm,preview", [
    (" Demo+Tag@Site.Example ", "demo@site.example", "de•••@site.example"), ("ab@x.example", "ab@x.example", "a•••@x.example"), ("plain", "plain", "•••"),
])
def test_email_forms(one, raw, norm, preview):
    assert one(text.normalize_email("e"), e=raw) == norm
    assert one(text.preview_email("e"), e=raw) == preview


def test_keyed_hash_is_hmac(one):
    key = b"k" * 80
    expected = hmac.new(key, b"demo@site.example", hashlib.sha256).hexdigest()
    assert one(keys.keyed_hash("e", key), e="Demo+x@site.example") == expected


def test_payload_hash_is_canonical_json(one):
    import json
    body = 'Line "one"\nzwei – ü'
    canonical = json.dumps({"recipient_hash": "r", "subject": "s", "body": body, "links": ["a", "b"], "attachments": [], "cost": 1.5, "from_email": "f"},
                           sort_keys=True, separators=(",", ":"), ensure_ascii=False).replace('"cost":1.5', '"cost":1.50')
    got = one(keys.payload_hash(F.lit("r"), F.lit("s"), F.col("b"), F.array(F.lit("b"), F.lit("a")), F.array().cast("array<string>"), F.lit(1.5), F.lit("f")), b=body)
    assert got == hashlib.sha256(canonical.encode()).hexdigest()


def test_excerpt_counts_code_points(one):
    t = "🎵" * 100 + " we run a PLAYLIST here " + "x" * 100
    got = one(text.excerpt_around("t", r"\bplaylist\b", 40), t=t)
    assert got.startswith("…🎵") and got.endswith("x…") and "PLAYLIST" in got
    assert one(text.excerpt_around("t", r"\bradio\b", 40), t=t) is None


def test_bounded_excerpt(one):
    assert one(text.bounded_excerpt("t", 10), t="  a \n b ") == "a b"
    assert one(text.bounded_excerpt("t", 10), t="abcdefghi jklm") == "abcdefghi…"
    assert one(text.bounded_excerpt("t"), t="   ") is None


def test_unicode_word_boundaries(one):
    assert one(text.matches("t", r"\bradio\b"), t="éradio") is False
    assert one(text.matches("t", r"\bradio\b"), t="Radio!") is True


@pytest.mark.parametrize("t,expected", [
    ("Dark electronic and techno", ["dark electronic", "techno"]), ("indie rock, indie and rock", ["indie rock"]),
    ("post-punk revival", ["post-punk", "punk"]), ("r&b and soul", ["r&b", "soul"]), ("popular", []),
])
def test_genres(one, t, expected):
    assert one(text.genres_in("t"), t=t) == expected


def test_slug_and_lists(one):
    assert one(text.slug("t"), t="  Ärger & Co.  ") == "ärger-co"
    assert one(text.slug("t"), t="!!!") == "untitled"
    assert one(text.comma_list("t"), t=" a, ,b ") == ["a", "b"]
    assert one(text.integer_list("t"), t="1, x, 20") == [1, 20]
    assert one(text.separated_integer("t"), t="12,000") == 12000
    assert one(text.separated_integer("t"), t="n/a") is None
    assert one(text.tri_state("t"), t="UNKNOWN") is None
    assert one(text.json_list("t"), t="not json") == []


def test_templates_drop_unfilled(one):
    assert one(text.fill_template(F.lit("{genre}  radio"), genre=F.col("g")), g="techno") == "techno radio"
    assert one(text.fill_template(F.lit("{genre} radio"), genre=F.lit(None).cast("string")), g="x") is None


@pytest.mark.parametrize("left,right,expected", [
    ([], ["a"], None), (["A "], ["a"], 1.0), (["a", "b", "c", "d"], ["a"], 1 / 3), (["dark electronic"], ["electronic"], 0.5), (["x"], ["y"], 0.0),
])
def test_overlap(one, left, right, expected):
    assert one(score.overlap("l", "r"), l=left, r=right) == (pytest.approx(expected) if expected is not None else None)


def test_unknown_never_counts_as_zero(one):
    parts = [(F.lit(1.0), 0.2), (F.lit(None).cast("double"), 0.8)]
    assert one(score.weighted_score(parts)) == 100
    assert one(score.covered_score(parts)) is None
    assert one(score.weighted_score([(F.lit(None).cast("double"), 1.0)])) is None
    assert one(score.weighted_score([(F.lit(None).cast("double"), 1.0)], empty=0)) == 0


def test_percent_keeps_its_empty_case(one):
    assert one(score.percent(F.lit(1), F.lit(0))) is None
    assert one(score.percent(F.lit(1), F.lit(0), 0)) == 0
    assert one(score.percent(F.lit(1), F.lit(8))) == 12  # 12.5 rounds to even


def test_risk_counts_each_signal_once(one):
    signals = F.array(*[F.lit(s) for s in ("honeypot_contact", "honeypot_contact", "injection_attempt")])
    assert one(score.risk_score(signals)) == 60
    assert one(score.risk_band(F.lit(75))) == "BLOCK" and one(score.risk_band(F.lit(20))) == "LOW RISK"


def test_time_helpers(one):
    as_of = "2024-03-01 00:00:00"
    assert one(when.days_since(when.parse_time(F.lit("2024-02-29T12:00:00Z")), as_of)) == 0.5
    assert one(when.parse_date_or_year(F.lit("2023"))).isoformat().startswith("2023-01-01")
    assert one(when.is_past(F.lit(None).cast("timestamp"), as_of)) is False
    assert one(when.days_until(F.lit(None).cast("timestamp"), as_of, 1)) is None
    assert one(when.activity_fit(F.lit(None).cast("double"))) is None
    assert one(when.activity_fit(F.lit(46.0))) == 0.5


def test_country_and_rule_sets(one):
    assert one(score.infer_country(F.lit("de"), F.lit("x.uk"))) == "DE"
    assert one(score.infer_country(F.lit(""), F.lit("x.co.uk"))) == "GB"
    assert one(score.rule_set(F.lit("FR"))) == "EU" and one(score.rule_set(F.lit(None).cast("string"))) == "OTHER"


def test_weights_sum_to_one():
    for table in (rules.OPPORTUNITY_COMPONENTS, rules.SCREENING_COMPONENTS, rules.FIT_COMPONENTS):
        assert abs(sum(row[1] for row in table) - 1.0) < 1e-9


def test_growth(one):
    assert one(score.growth_percent(F.array(F.lit(10), F.lit(15)))) == 50
    assert one(score.growth_percent(F.array(F.lit(0), F.lit(15)))) is None
    assert one(score.growth_percent(F.array(F.lit(3)))) is None


def test_genres_equal_a_plain_reading(spark):
    import random
    import re
    rng = random.Random(5)
    texts = [rng.choice(["", "x"]) + rng.choice([" ", "-", ", ", ""]).join(rng.choice(rules.GENRES + ["of", "dark", "indie"]) for _ in range(rng.randrange(1, 7)))
             for _ in range(400)]

    def plain(t):
        found = [g for g in rules.GENRES if re.search(r"\b" + re.escape(g) + r"\b", t.lower())]
        specific = [g for g in found if " " in g or "-" in g]
        return specific + [g for g in found if g not in specific and not any(g in s.split() for s in specific)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", text.genres_in("t").alias("g")).collect():
        assert r["g"] == plain(r["t"]), r["t"]


def test_needed_words_never_change_a_result(spark):
    """The word test in front of a rule may only skip texts that cannot match."""
    import random
    rng = random.Random(9)
    words = ["submit", "Your", "music", "ſubmission", "FEE", "of", "no", "free", "to", "playlist", "premiere", "radio", "station", "we", "guarantee", "streams",
             "100", "blog", "in", "conversation", "with", "q & a", "trend", "strategies", "DJ", "pool", "closed", "are", "submissions", "log", "log in"]
    df = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(8)),) for _ in range(500)], "t string").withColumn("low", text.fold("t"))
    patterns = [p for _l, _w, p in rules.PAGE_CLASS_RULES] + rules.OPEN_PATTERNS + rules.CLOSED_PATTERNS + rules.LOGIN_PATTERNS + [
        p for _l, p in rules.COVERAGE_KIND_RULES + rules.TREND_RULES + rules.CATEGORY_RULES + rules.SERVICE_TYPE_RULES] + [rules.FREE_SUBMISSION_PATTERN, rules.FEE_PATTERN]
    differ = [F.sum((text.matches("t", p) != text.matches("t", p, folded=F.col("low"))).cast("int")).alias(f"d{i}") for i, p in enumerate(patterns)]
    assert set(df.agg(*differ).first()) == {0}


def test_an_excerpt_looks_for_its_match_once(spark):
    rows = [("a 𝄞 robots. Bots\nand more bots", r"\bbots\b"), ("no match known", None), (None, r"\bbots\b")]
    df = spark.createDataFrame(rows, "t string, p string")
    out = df.select(text.excerpt_around("t", F.col("p"), 4).alias("x"))
    assert [r["x"] for r in out.collect()] == ["….  Bots a…".replace("  ", " "), None, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2


def test_first_place_is_counted_in_code_points_without_split(spark):
    from wayfold.functions import passages
    df = spark.createDataFrame([("a 𝄞 robots. Bots\nand more bots",), ("none",), ("",), (None,), ("bots",)], "t string")
    out = df.select(passages.first_place(F.col("t"), r"\bbots\b|\bmore\b").alias("p"))
    assert [r["p"] and (r["p"]["start"], r["p"]["end"]) for r in out.collect()] == [(12, 16), None, None, None, (0, 4)]
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
