import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import chain, containment, folds, graph, joins, labels, latest, quality, scans, upsert
from wayfold.session import release_kept


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


@pytest.fixture
def skewed(spark):
    """900 log rows; one key holds more than a third of them."""
    rng = random.Random(7)
    data = [(("hot" if i % 5 < 2 else f"k{rng.randrange(20)}"), 1_700_000_000 + rng.randrange(5 * 86_400), i, rng.choice(["A", "B", None]), rng.randrange(9))
            for i in range(900)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "key string, sec bigint, seq bigint, label string, n int").withColumn("ts", F.timestamp_seconds("sec"))
    return data, df


@pytest.mark.parametrize("partitions", [1, 8])
def test_newest_and_oldest(skewed, partitions):
    data, df = skewed
    df = df.repartition(partitions)
    best = {}
    for k, s, q, *_ in data:
        best[k] = max(best.get(k, (0, 0)), (s, q))
    got = {r["key"]: (r["sec"], r["seq"]) for r in latest.newest_per_key(df, ["key"], ["ts", "seq"], ["sec", "seq"]).collect()}
    assert got == best
    worst = {r["key"]: r["seq"] for r in latest.oldest_per_key(df, ["key"], ["ts", "seq"], ["seq"]).collect()}
    assert worst == {k: min((s, q) for kk, s, q, *_ in data if kk == k)[1] for k in best}


def test_same_second_goes_to_the_later_row(frame):
    df = frame([("a", 1, 1, "first"), ("a", 1, 2, "second")], "k string, t int, seq int, v string")
    assert latest.newest_per_key(df, ["k"], ["t", "seq"], ["v"]).first()["v"] == "second"


@pytest.mark.parametrize("partitions", [1, 8])
def test_cap_keeps_every_row(skewed, partitions):
    data, df = skewed
    out = latest.cap_per_key(df.repartition(partitions), ["key"], ["seq"], 5, "BUDGET")
    got = out.select("key", "seq", "skipped").collect()
    assert len(got) == len(data)
    for key in {d[0] for d in data}:
        kept = sorted(r["seq"] for r in got if r["key"] == key and r["skipped"] is None)
        assert kept == sorted(d[2] for d in data if d[0] == key)[:5]


def test_round_robin_interleaves_families(frame):
    df = frame([(1, f, i) for f, n in (("b", 5), ("a", 1), ("c", 2)) for i in range(n)], "s int, family string, place int", 3)
    got = [(r["family"], r["turn"]) for r in latest.round_robin(df, ["s"], "family", ["place"], 6).orderBy("position").collect()]
    assert got == [("a", 1), ("b", 1), ("c", 1), ("b", 2), ("c", 2), ("b", 3)]


def test_ordered_distinct_keeps_first_spelling(frame):
    df = frame([(1, "Techno", 0), (1, " techno", 1), (1, "House", 2)], "s int, t string, p int")
    assert rows(latest.ordered_distinct(df, ["s"], "t", ["p"]), "t") == [("House",), ("Techno",)]


@pytest.fixture(params=[1, 7, 40])
def parts(spark, request):
    """A session that deals ranges to so many parts, however small they are."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    release_kept()
    for k, v in old.items():
        spark.conf.set(k, v)


def test_scans_do_not_depend_on_the_parts(skewed, parts):
    data, df = skewed
    total = {r["seq"]: r["t"] for r in scans.running_total(df, ["key"], ["ts", "seq"], "n", "t").collect()}
    carried = {r["seq"]: r["c"] for r in scans.carry_last(df, ["key"], ["ts", "seq"], "label", "c").collect()}
    before = {r["seq"]: r["p"] for r in scans.previous_value(df, ["key"], ["ts", "seq"], "label", "p").collect()}
    assert len(total) == len(carried) == len(before) == len(data)
    for key in {d[0] for d in data}:
        acc, held, last = 0, None, None
        for _k, _s, q, label, n in sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2])):
            acc, held = acc + n, label or held
            assert (total[q], carried[q], before[q]) == (acc, held, last)
            last = label


def test_rows_of_one_key_and_one_time_are_spread_over_tasks(spark, parts):
    n = 40_000
    df = spark.range(n, numPartitions=8).selectExpr("'hot' AS key", "timestamp '2024-01-01' AS ts", "id AS seq", "1L AS one")
    sizes = [r["count"] for r in scans.in_parts(df, ["key"], ["ts", "seq"]).groupBy(scans.PART).count().collect()]
    assert sum(sizes) == n and len(sizes) >= 0.8 * parts and max(sizes) <= 2 * n / parts
    out = scans.running_total(df, ["key"], ["ts", "seq"], "one", "t")
    assert out.filter("t <> seq + 1").count() == 0


def test_no_job_runs_while_a_scan_is_planned_and_the_table_is_read_once(spark, tmp_path, parts):
    spark.range(1000).selectExpr("id % 3 AS key", "timestamp_seconds(id) AS ts", "id AS seq", "id % 2 = 0 AS a").write.parquet(f"{tmp_path}/t")
    df = spark.read.schema("key long, ts timestamp, seq long, a boolean").parquet(f"{tmp_path}/t")
    tracker, group = spark.sparkContext.statusTracker(), f"plan-{parts}"
    spark.sparkContext.setJobGroup(group, "planning")
    out = [scans.as_of_rows(df, ["key"], "ts", "seq", F.col("a"), ~F.col("a"), ["seq"], "hit"),
           scans.trailing_count(df, ["key"], "ts", 100, "n"), scans.previous_value(df, ["key"], ["ts", "seq"], "a", "p")]
    assert not tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for df in out:
        scanned = {line.split("FileScan")[1] for line in df._jdf.queryExecution().toString().splitlines() if "FileScan" in line}
        assert len(scanned) <= 1
    assert out[0].filter("hit IS NULL").count() == 2  # of keys 0 and 2 the first row asks; key 1 begins with an answer


def test_a_scan_sees_rows_written_since_an_earlier_one(spark, tmp_path):
    for n in (10, 25):
        spark.range(n).selectExpr("1 AS key", "id AS seq", "1L AS one").write.mode("overwrite").parquet(f"{tmp_path}/t")
        df = spark.read.parquet(f"{tmp_path}/t")
        assert scans.running_total(df, ["key"], ["seq"], "one", "t").agg(F.max("t")).first()[0] == n
    release_kept()


def test_as_of_rows_may_ask_and_answer(frame):
    df = frame([("a", 10, 1), ("a", 10, 2), ("a", 20, 3), ("b", 5, 4)], "k string, s bigint, id bigint").withColumn("ts", F.timestamp_seconds("s"))
    out = scans.as_of_rows(df, ["k"], "ts", "id", F.lit(True), F.col("id") != 3, ["id"], "hit")
    assert {r["id"]: r["hit"] and r["hit"]["id"] for r in out.collect()} == {1: 2, 2: 2, 3: 2, 4: 4}
    none = scans.as_of_rows(df.limit(0), ["k"], "ts", "id", F.lit(True), F.lit(True), ["id"], "hit")
    assert none.count() == 0


def test_trailing_count_includes_both_ends(frame):
    base = 1_700_000_000
    df = frame([("a", base), ("a", base + 86_400), ("a", base + 86_401), ("a", base + 86_401)], "k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["ts"].timestamp() - base: r["n"] for r in scans.trailing_count(df, ["k"], "ts", 86_400, "n").collect()}
    assert got == {0: 1, 86_400: 2, 86_401: 3}


def test_as_of_join_takes_the_newest_earlier_row(frame):
    left = frame([("a", 10, 1), ("a", 5, 2), ("b", 7, 3)], "k string, s bigint, id int").withColumn("ts", F.timestamp_seconds("s"))
    right = frame([("a", 5, 1), ("a", 5, 2), ("a", 9, 3), ("b", 8, 4)], "k string, s bigint, seq bigint").withColumn("rt", F.timestamp_seconds("s"))
    out = scans.as_of_join(left, right, ["k"], "ts", "rt", ["seq"], ["seq"], "hit")
    assert {r["id"]: r["hit"] and r["hit"]["seq"] for r in out.collect()} == {1: 3, 2: 2, 3: None}


def test_upsert_rules(frame):
    base = frame([(None, "OPEN", 5, "page", "old")], "k string, state string, n int, src string, name string")
    changes = frame([(None, "UNKNOWN", None, "api", "new", 1), ("x", "UNKNOWN", 7, "api", "x", 2), (None, "UNKNOWN", None, None, None, 3)],
                    "k string, state string, n int, src string, name string, seq int", 3)
    out = upsert.upsert(base, changes, ["k"], ["seq"], {"state": "never_unknown", "n": "last_known", "src": upsert.paired_with("n"), "name": "last_known"})
    assert rows(out) == [("x", "UNKNOWN", 7, "api", "x"), (None, "OPEN", 5, "page", "new")]


def test_category_may_only_strengthen(frame):
    rule = upsert.strengthen_category("WEAK", ["STRONG"])
    changes = frame([("a", "WEAK", 1), ("a", "STRONG", 2), ("b", "STRONG", 1), ("b", "WEAK", 2), ("c", "OTHER", 1), ("c", "STRONG", 2)], "k string, c string, seq int")
    out = upsert.upsert(changes.select("k", "c").limit(0), changes, ["k"], ["seq"], {"c": rule})
    assert rows(out) == [("a", "STRONG"), ("b", "STRONG"), ("c", "OTHER")]


def test_insert_if_absent_is_null_safe(frame):
    base = frame([("h", None)], "value_hash string, tenant string")
    new = frame([("h", None), ("h", "t"), ("g", None), ("g", None)], "value_hash string, tenant string")
    assert rows(upsert.insert_if_absent(base, new, ["value_hash", "tenant"], ["value_hash"])) == [("g", None), ("h", "t"), ("h", None)]


def test_forget_provider_loosens_references(frame):
    docs = frame([("d1", "video"), ("d2", "web")], "id string, provider string")
    ev = frame([("e1", "OFFICIAL", "d1"), ("e2", "VIDEO", "d2"), ("e3", "OFFICIAL", "d2")], "id string, source_type string, source_document_id string")
    kept, loose = upsert.forget_provider(docs, ev, "video")
    assert rows(kept) == [("d2", "web")]
    assert rows(loose) == [("e1", "OFFICIAL", None), ("e3", "OFFICIAL", "d2")]


def test_tri_state_conflict_is_unknown(frame):
    df = frame([("s", "f1", True, 0.7), ("s", "f1", False, 0.7), ("s", "f2", True, 0.9), ("s", "f2", False, 0.7), ("s", "f3", False, 0.1)],
               "s string, field string, value boolean, confidence double")
    assert rows(folds.tri_state_fold(df, ["s", "field"])) == [("s", "f1", None, True), ("s", "f2", True, False), ("s", "f3", False, False)]


def test_supersession_keeps_only_the_newest_read(frame):
    df = frame([("s", "u", "h1", 1, 1), ("s", "u", "h2", 1, 2), ("s", "u", "h2", 1, 3), ("s", "v", None, 5, 4), ("s", "v", "h9", 5, 5), ("s", "w", "h9", 5, 6), ("s", "w", None, 5, 7)],
               "s string, url string, content_hash string, retrieved_at int, seq int")
    assert rows(folds.current_batch(df, ["s", "url"], ["seq"]), "seq") == [(2,), (3,), (5,), (6,), (7,)]


def test_override_may_be_tightened_never_loosened(frame):
    log = frame([("a", "BLOCKED", True, 1), ("a", "SCREENED", False, 2), ("b", "SCREENED", True, 1), ("b", "BLOCKED", False, 2), ("c", "BLOCKED", False, 1), ("c", "CAUTION", True, 2),
                 ("d", "UNKNOWN", False, 1)], "s string, status string, human_override boolean, seq int")
    got = {r["s"]: r["effective_status"] for r in folds.effective_status(log, ["s"], ["seq"]).collect()}
    assert got == {"a": "BLOCKED", "b": "BLOCKED", "c": "CAUTION", "d": "UNKNOWN"}
    last = {}
    for r in folds.effective_history(log, ["s"], ["seq"]).orderBy("seq").collect():
        last[r["s"]] = r["effective_status"]
    assert last == got


def test_payment_time_survives_a_decline_and_ends_with_a_refund(frame):
    log = frame([("a", "PAID", 1), ("a", "DECLINED", 2), ("b", "PAID", 1), ("b", "REFUNDED", 2), ("c", "PAID", 1), ("c", "REFUNDED", 2), ("c", "PAID", 3), ("c", "PAID", 4)],
                "i string, status string, seq int")
    assert rows(folds.plan_state(log, ["i"], ["seq"], "seq")) == [("a", "DECLINED", 1), ("b", "REFUNDED", None), ("c", "PAID", 3)]


def test_human_field_is_never_replaced(frame):
    log = frame([("p", "mood", "dark", True, 1), ("p", "mood", "derived", False, 2), ("p", "bpm", "1", True, 1), ("p", "bpm", None, True, 2), ("p", "bpm", "2", False, 3)],
                "p string, field string, value string, human boolean, seq int")
    assert rows(folds.field_state(log, ["p", "field"], ["seq"])) == [("p", "bpm", "2", False), ("p", "mood", "dark", True)]


@pytest.mark.parametrize("vocabulary, closed", [([], False), (["b", "a", "z"], False), ([f"v{k}" for k in range(130)] + list("abcdz"), True)])
def test_unions_of_labels_equal_sets(frame, vocabulary, closed):
    rng = random.Random(len(vocabulary))
    data = [(rng.choice(["k", "l", None]), rng.choice([None, [], ["a"], ["b", "a", "a"], ["d", None, "c"], ["z", "b"]]), i) for i in range(200)] + [("only null", None, 999)]
    df = frame(data, "k string, x array<string>, n int", 5)
    out = labels.union_of_labels(df, ["k"], {"x": labels.Labels(vocabulary, closed)}, F.max("n").alias("n"))
    want = {k: (sorted({y for a, x, _ in data if a == k for y in x or [] if y}), max(n for a, _, n in data if a == k)) for k in {d[0] for d in data}}
    assert {r["k"]: (r["x"], r["n"]) for r in out.collect()} == want


def test_upsert_unites_lists(frame):
    base = frame([("a", ["old", "x"]), ("b", None), (None, ["x"])], "k string, x array<string>")
    changes = frame([("a", ["new", "x"], 1), ("c", ["y"], 1), (None, ["new"], 2)], "k string, x array<string>, seq int")
    for rule in (upsert.UNION, labels.Labels(["x", "old"]), labels.Labels(["x", "old", "new", "y"], closed=True)):
        got = {r["k"]: r["x"] for r in upsert.upsert(base, changes, ["k"], ["seq"], {"x": rule}).collect()}
        assert got == {"a": ["new", "old", "x"], "b": [], "c": ["y"], None: ["new", "x"]}


def test_merge_roots_chain_cycle_and_tail(frame):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (102, 100), (103, 102), (200, 201)]
    got = {r["loser"]: (r["root"], r["on_cycle"]) for r in graph.merge_roots(frame(edges, "loser bigint, winner bigint", 3)).collect()}
    assert all(got[i] == (40, False) for i in range(1, 40))
    assert got[100] == (100, True) and got[101] == (101, True)
    assert got[102] == (100, False) and got[103] == (100, False) and got[200] == (201, False)


def test_undone_merges_are_left_out(frame):
    log = frame([("outlet", "a", "b", 1, False), ("outlet", "c", "d", 2, True), ("outlet", "e", "f", 3, False), ("outlet", "e", "g", 4, False)],
                "entity_type string, loser_id string, winner_id string, seq int, undone boolean")
    assert rows(graph.live_edges(log), "loser", "winner") == [("a", "b"), ("e", "g")]


def test_contains_join_equals_brute_force(spark, frame):
    rng = random.Random(3)
    words = ["an", "the", "nova", "super", "ring", "é", "x", "of", "light", "superring"]
    seps = [" ", ", ", "-", ". "]

    def sentence(n):
        return "".join(rng.choice(words) + rng.choice(seps) for _ in range(n)).strip()
    texts = [(1 if i % 2 else 2, i, sentence(rng.randrange(1, 30)).title()) for i in range(120)] + [(1, 999, None), (1, 998, "")]
    names = [(1 if i % 3 else 2, i, sentence(rng.randrange(1, 5))) for i in range(80)] + [(1, 900, "!"), (1, 901, "-"), (1, 902, "s"), (2, 903, "he n")]
    out = containment.contains_join(frame(texts, "t int, id int, text string", 3), frame(names, "t int, nid int, name string", 3), ["id"], "text", "name", ["t"])
    want = sorted((i, n) for t, i, x in texts for u, n, nm in names if t == u and x and nm.lower() in x.lower())
    assert sorted((r["id"], r["nid"]) for r in out.collect()) == want and want


def test_contains_join_reads_a_text_twice_and_cuts_at_the_place(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(containment, "TOGETHER", 3)
    spark.createDataFrame([(i, f"{'x ' * i}Aa bb cc dd ee ff gg{' y' * i}", i % 3) for i in range(50)], "id int, text string, lang int").write.parquet(f"{tmp_path}/t")
    texts = spark.read.schema("id int, text string, lang int").parquet(f"{tmp_path}/t")
    names = spark.createDataFrame([(k, n) for k, n in enumerate(["aa", "bb cc", "dd", "ee ff", "gg", "a bb cc d", "zz", "FF G"])], "nid int, name string")
    out = containment.contains_join(texts, names, ["id"], "text", "name", excerpt_width=4)
    scans_of_text = {line.split("FileScan")[1] for line in out._jdf.queryExecution().toString().splitlines() if "FileScan" in line and "text:string" in line}
    assert len(scans_of_text) == 2 and "text" not in out.columns
    got = {(r["id"], r["nid"]): (r["at"], r["excerpt"], r["lang"]) for r in out.collect()}
    assert len(got) == 50 * 7
    assert got[0, 0] == (1, "Aa b…", 0) and got[10, 0] == (21, "…x Aa b…", 1)
    for (i, n), (at, excerpt, _) in got.items():
        text = f"{'x ' * i}Aa bb cc dd ee ff gg{' y' * i}"
        name = ["aa", "bb cc", "dd", "ee ff", "gg", "a bb cc d", "zz", "FF G"][n].lower()
        assert at == text.lower().index(name) + 1
        a, b = max(0, at - 3), min(len(text), at - 1 + len(name) + 2)
        assert excerpt == ("…" if a else "") + " ".join(text[a:b].split()) + ("…" if b < len(text) else "")


def test_contains_join_moves_hashes_of_few_names_and_no_pieces(spark, frame, monkeypatch):
    texts = frame([(i, f"x{i} nova super ring {'light ' * i}") for i in range(20)], "id int, text string", 3)
    names = frame([(1, "the nova super"), (2, "x5 nova super ring"), (3, "ova"), (4, "t x")], "nid int, name string")
    want = [(5, 2), *[(i, 3) for i in range(20)]]
    for sent in (100, 0):
        monkeypatch.setattr(containment, "SENT", sent)
        out = containment.contains_join(texts, names, ["id"], "text", "name")
        assert sorted((r["id"], r["nid"]) for r in out.collect()) == sorted(want)
        plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        moved = next(k for k, line in enumerate(plan) if "RepartitionByExpression [id" in line)
        assert "__id" in plan[moved + 1] and "__fold" not in plan[moved + 1]
        assert ("rightHint=(strategy=broadcast)" in plan[moved + 2]) is (sent > 0) and "__piece" in plan[moved + 2]


def test_term_search_counts_repeats_and_substrings(frame):
    pages = frame([("p1", "dubtechno radio"), ("p2", "radio"), ("p3", "nothing")], "page string, text string")
    queries = frame([("q", "submit techno techno radio music")], "q string, query string")
    got = [(r["page"], r["score"]) for r in containment.term_search(pages, queries, "page", "text", "q", "query", 10).orderBy("rank").collect()]
    assert got == [("p1", 3), ("p2", 1)]


def audit_rows(frame, n=6):
    return frame([(i, t, "USER", None, "act", "e", str(i), "{}", f"2024-01-0{i}") for t in ("t1", "t2") for i in range(1, n)],
                 "seq bigint, tenant_id string, actor_kind string, actor_id string, action string, entity_type string, entity_id string, payload_json string, created_at string", 3)


def test_chain_holds_and_shows_the_first_break(spark, frame):
    tails = spark.createDataFrame([], "tenant_id string, hash string")
    log = chain.build_chain(audit_rows(frame), tails)
    assert rows(chain.verify_chain(log)) == [("t1", None, 5), ("t2", None, 5)]
    edited = log.withColumn("action", F.when((F.col("tenant_id") == "t1") & (F.col("seq") == 3), "forged").otherwise(F.col("action")))
    assert rows(chain.verify_chain(edited)) == [("t1", 3, 5), ("t2", None, 5)]
    deleted = log.filter("NOT (tenant_id = 't2' AND seq = 2)")
    assert rows(chain.verify_chain(deleted)) == [("t1", None, 5), ("t2", 3, 4)]


def test_chain_goes_on_from_the_stored_tail(spark, frame):
    empty = spark.createDataFrame([], "tenant_id string, hash string")
    whole = chain.build_chain(audit_rows(frame), empty)
    first = whole.filter("seq <= 3")
    tails = first.groupBy("tenant_id").agg(F.max_by("hash", "seq").alias("hash"))
    rest = chain.build_chain(audit_rows(frame).filter("seq > 3"), tails)
    assert rows(first.unionByName(rest), "tenant_id", "seq", "hash") == rows(whole, "tenant_id", "seq", "hash")


def test_null_safe_join_and_or_key_flag(frame):
    left = frame([(1, None), (2, "a"), (3, "b")], "id int, k string")
    right = frame([(None, "n"), ("a", "x")], "k string, v string")
    assert rows(joins.null_safe_join(left, right, ["k"]), "id", "v") == [(1, "n"), (2, "x"), (3, None)]
    marks = frame([(None, "b"), ("a", None), ("a", None)], "k1 string, k2 string")
    got = joins.or_key_flag(left, marks, [("k", "k1"), ("k", "k2")], "id", [], "flag")
    assert rows(got, "id", "flag") == [(1, None), (2, 1.0), (3, 1.0)]


def test_scoped_suppression(frame):
    methods = frame([("h1", "t1"), ("h1", "t2"), ("h2", "t1"), ("h2", "t2"), ("h3", "t1")], "value_hash string, tenant_id string")
    reg = frame([("h1", "TENANT", "t1", "own"), ("h2", "GLOBAL", None, "all")], "value_hash string, scope string, tenant_id string, reason string")
    assert rows(joins.scoped_match(methods, reg), "value_hash", "tenant_id", "suppression_reason") == [
        ("h1", "t1", "own"), ("h1", "t2", None), ("h2", "t1", "all"), ("h2", "t2", "all"), ("h3", "t1", None)]


def test_spec_join_separates_unknown_from_absent(frame):
    keys = frame([("p",)], "profile string")
    vals = frame([("p", "mood", "dark")], "profile string, field string, value string")
    out = joins.spec_join(keys, "profile", vals, [("mood", "list", True), ("bpm", "number", False)])
    assert rows(out, "field", "known", "display") == [("bpm", False, "UNKNOWN"), ("mood", True, "dark")]


def test_quality_checks(frame):
    df = frame([("c", "o"), ("c", "o"), ("c", "p")], "campaign_id string, outlet_id string")
    assert rows(quality.duplicates(df, quality.UNIQUE_KEYS["campaign_target"])) == [("c", "o", 2)]
    assert rows(quality.orphans(frame([("p1", "e1"), ("p2", None)], "id string, evidence_id string"), "evidence_id", frame([("e1",)], "id string"), "id"), "id") == [("p2",)]
    rel = frame([("a", "PARTNER", None), ("b", "PARTNER", "shown"), ("c", None, None)], "id string, relation string, disclosure string")
    assert rows(quality.undisclosed_relations(rel), "id") == [("a",)]


def test_recontact_wait_follows_the_newest_outcome(frame):
    log = frame([("o", "TOUCH", 1), ("o", "DECLINE", 2)], "o string, kind string, seq int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    r = folds.recontact_state(log, ["o"], ["seq"], "ts").first()
    assert (r["next_eligible_at"] - r["last_contact_at"]).days == 365 and r["declined_count"] == 1


def search_corpus(rng):
    words = [f"w{'abcdefgh'[k % 8]}{k}" for k in range(40)]
    pages = [(p, " ".join(["everywhere", *rng.sample(words, rng.randint(0, 6))])) for p in range(600)]
    queries = [(q, " ".join(rng.choices([*words, "everywhere", "wa", "nowhere", "the"], k=rng.randint(1, 5)))) for q in range(80)]
    return pages, queries + [(900, "everywhere"), (901, "the"), (902, "everywhere everywhere wa0"), (903, "")]


@pytest.mark.parametrize("limit", [1, 3, 25, 1000])
def test_term_search_equals_scoring_every_pair(frame, limit):
    pages, queries = search_corpus(random.Random(limit))
    want = set()
    for q, asked in queries:
        terms = [t for t in asked.split() if t != "the"]
        best = sorted((-n, p) for p, text in pages if (n := sum(t in text for t in terms)))
        want |= {(q, p, -n, k) for k, (n, p) in enumerate(best[:limit], 1)}
    out = containment.term_search(frame(pages, "page int, text string", 3), frame(queries, "q int, query string", 2), "page", "text", "q", "query", limit)
    assert {(r["q"], r["page"], r["score"], r["rank"]) for r in out.collect()} == want
    release_kept()


def test_a_term_of_all_pages_brings_no_product(spark, frame):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    sets = frame([(p, sorted(["everywhere", *rng.sample(words, 4)])) for p in range(5000)], "page int, terms array<string>", 4)
    asked = frame([(q, t, 1) for q in range(50) for t in ("everywhere", f"w{q}")], "q int, term string, times bigint")
    shown = containment.folded_sets(sets, "page", 5)
    pairs = containment.candidates(shown, asked, "page", "q", 5)
    rare = shown.select(F.explode("terms").alias("term")).filter(F.col("term").isin([f"w{q}" for q in range(50)])).count()
    assert pairs.count() <= rare + 2 * 5 * 50 < 0.05 * 50 * 5000
    alike = frame([(p, ["everywhere"]) for p in range(5000)], "page int, terms array<string>", 4)
    assert sorted(r["page"] for r in containment.folded_sets(alike, "page", 5).collect()) == [0, 1, 2, 3, 4]
    release_kept()
