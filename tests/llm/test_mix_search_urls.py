import random

import numpy as np
from pyspark.sql import functions as F

from wayfold.llm import ann, mixing, toxicity, url_rules
from wayfold.llm.common import fold_is
from tests.llm.helpers import DOCS, LABELS, docs, written


def test_targets_stop_at_their_caps():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    out = mixing.targets([1000, 10, 5], [1, 2, 3])
    assert out[1:] == [30.0, 15.0] and sum(out) == 1015.0
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_tree_deals_exact_quotas():
    quotas = [1000, 17, 0, 333]
    out = mixing.split_tree(quotas, 7, 3)
    assert out.sum(axis=0).tolist() == quotas and (out >= 0).all()
    assert np.ptp(out.sum(axis=1)) <= 1 and (out == mixing.split_tree(quotas, 7, 3)).all()
    means = np.mean([mixing.split_tree([400, 100], 2, s)[0] for s in range(300)], axis=0)
    assert abs(means[0] - 200) < 2 and abs(means[1] - 50) < 2


def test_mix_meets_every_target(spark):
    rng = random.Random(1)
    sources = ["a"] * 120 + ["b"] * 60 + [None] * 6 + ["é"] * 10
    texts = [" ".join(["w"] * rng.randint(0, 40)) for _ in sources]
    texts[0] = None
    df = docs(spark, texts, sources).withColumn("size", F.lit("clash"))
    base = docs(spark, texts, sources)
    for whole in (False, True):
        rows = mixing.mix(base.repartition(4), shards=5, block_words=100, whole=whole).collect()
        assert len(rows) == len(texts)
        for s in {*sources}:
            own = [r for r in rows if r.source == s]
            taken = sum(d.words for r in own for d in r.draws)
            assert own[0].source_size == sum(r.size for r in own)
            assert abs(taken - own[0].target) <= (max(r.size for r in own) if whole else 1)
        for r in rows:
            assert sum(d.words for d in r.draws) <= 3 * r.size and len({d.epoch for d in r.draws}) == len(r.draws)
            assert all(d.words <= r.size and 0 <= d.shard < 5 for d in r.draws)
        again = mixing.mix(base.repartition(2), shards=5, block_words=100, whole=whole).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(df.drop("size"), shards=2).columns[:5] == base.columns
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    drawn = mixing.shuffled(mixing.mix(base, shards=5), base.columns)
    assert drawn.columns == [*base.columns, "shard", "epoch", "words"] and drawn.where("words <= 0").count() == 0


def test_mix_keeps_columns_that_clash(spark):
    base = docs(spark, ["a b c", "d e", "f"], ["x", "y", None])
    names = ["size", "source_size", "target", "draws", "p", "b", "q", "shard", "epoch", "words", "rank", "n", "s", "count", "draw"]
    df = base.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in names])
    rows = mixing.mix(df, shards=2).collect()
    want = {r.doc_id: r for r in mixing.mix(base, shards=2).collect()}
    for r in rows:
        assert [r[c] for c in names] == [f"{c}{r.doc_id}" for c in names]
        assert [r["__" + c] for c in ("size", "source_size", "target", "draws")] == [want[r.doc_id][c] for c in ("size", "source_size", "target", "draws")]
    drawn = mixing.shuffled(mixing.mix(df, shards=2), df.columns)
    assert drawn.columns == [*df.columns, "__shard", "__epoch", "__words"]
    assert {r["shard"] for r in drawn.collect()} <= {f"shard{i}" for i in (1, 2, 3)}


def test_mix_query_and_stage_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline
    from wayfold.llm import queries
    base = docs(spark, ["a b c", "d e", "f"], ["x", "y", None])
    df = base.selectExpr("*", *[f"'own' AS {c}" for c in ("size", "source_size", "target", "draws", "p", "b", "q", "shard", "words")])
    plain, clash = (written({"documents": d}, tmp_path / n) for d, n in ((base, "plain"), (df, "clash")))
    assert sorted(queries.op2_source_mix(spark, clash).collect()) == sorted(queries.op2_source_mix(spark, plain).collect())
    staged = corpus_pipeline.mixture(spark, df, clash)
    assert staged.columns == df.columns and {r.target for r in staged.collect()} == {"own"}
    assert sorted(r.doc_id for r in staged.collect()) == sorted(r.doc_id for r in corpus_pipeline.mixture(spark, base, plain).collect())


def exact(vectors, query_id, k):
    (q,) = [v for i, v in vectors if i == query_id]
    return sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), i) for i, v in vectors if i != query_id)[:k]


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((6, 40)) * 2
    points = (centers[rng.integers(0, 6, 1500)] + rng.standard_normal((1500, 40))).astype("float32")
    points[300:700] = points[300]  # one vector many times
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    odd = [(5000, None), (5100, [0.0] * 40), (5200, [float("nan")] * 40), (5300, [1.0] * 39), (None, [1.0] * 40), (5400, [None] + [1.0] * 39),
           (5500, [float("inf")] * 40)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("list", F.lit("x"))
    out = ann.search(df.repartition(4), F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 1500, 100))
    hits = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        best = exact(vectors, q, 10)
        assert [r["rank"] for r in rows] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        hits += len({r.vec_id for r in rows} & {i for _, i in best})
        if 300 <= q < 700:
            assert [r.vec_id for r in rows] == [i for _, i in best]
    assert hits >= 0.9 * 10 * len(by)


def test_search_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (100, [0.0, 2.0])], schema)
    out = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(few, F.col("vec_id") % 100 == 0).collect())
    assert out == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]
    assert ann.search(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(spark.createDataFrame([(0, [0.0])], schema), F.lit(True)).count() == 0


def test_repeated_rows_and_own_ids_take_no_places(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((60, 8)))]
    same = [(1000 + i, vectors[40][1]) for i in range(5)]
    several = [(0, [x + 1e-3 * j for x in vectors[0][1]]) for j in range(1, 26)] + [(7, [x + 1e-4 * j for x in vectors[7][1]]) for j in range(3)][1:]
    rows = vectors * 2 + [vectors[0]] * 20 + [vectors[40]] * 30 + same * 3 + several
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asks = F.col("vec_id").isin(0, 7, 40, 1000)
    out = {}
    for r in ann.search(df, asks, probes=1000).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    distinct = {(i, tuple(v)) for i, v in rows}
    for q in (40, 1000):
        best = sorted((float(np.linalg.norm(np.array(v) - vectors[40][1])), i) for i, v in distinct if i != q)[:10]
        assert [i for _, i, _ in sorted(out[q])] == [i for _, i in best]
        assert np.allclose([s for _, _, s in sorted(out[q])], [s for s, _ in best])
    assert sorted(n for n, _, _ in out[0]) == sorted([*range(1, 11)] * 26)  # each of its vectors once, with all its neighbours
    assert sorted(n for n, _, _ in out[7]) == sorted([*range(1, 11)] * 3)
    assert all(i != q for q in out for _, i, _ in out[q])


def test_fixed_rules_and_mined_rules(spark):
    urls = [f"https://a{i}.example.com/en/spam/{i}?ref=x" for i in range(40)] + [f"https://b{i}.example.com/en/news/{i}" for i in range(60)]
    urls += ["http://X.NET", "http://x.net/", "http://example.net/en/1", "http://www.Example.COM/de/", "http://q.org/fr/a", "http://notnet/",
             None, "no scheme", "", "ftp://anet/de/#f", "https://h/spam/1", "http://u.example.com/en/spam/x?y#z", "http://x.example.com\n/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(100)] + [(1, 1, 0), (2, None, None), (10 ** 6, 0, 1)], LABELS)
    out = {r.page_id: r for r in url_rules.judge(pages.repartition(3), labels).collect()}
    assert len(out) == len(urls)
    assert all(out[i].verdict == "block" and out[i].rule is None for i in range(40))
    assert all(out[i].verdict == "allow" for i in range(40, 100))
    want = {100: (None, "allow"), 101: ("net/", "block"), 102: ("example.net/en/", "allow"), 103: ("example.com/de/", "block"), 104: ("org/fr/", "allow"),
            105: (None, "allow"), 106: (None, "allow"), 107: (None, "allow"), 108: (None, "allow"), 111: (None, "block")}
    assert {i: (out[i].rule, out[i].verdict) for i in want} == want
    assert (out[111].host, out[111].path) == ("u.example.com", "/en/spam/x") and (out[107].host, out[107].path) == ("", "")
    assert "p:spam" in out[111].mined_rule
    nothing = spark.createDataFrame([], LABELS)
    assert url_rules.judge(pages, nothing).where("verdict = 'block'").count() == 2
    assert url_rules.judge(spark.createDataFrame([], pages.schema), labels).count() == 0


def test_mined_rules_equal_counts(spark):
    rng = random.Random(6)
    rows = [(sorted(rng.sample("abcdef", rng.randint(1, 4))), rng.random() < 0.4) for _ in range(300)]
    got = {tuple(r.rule): (r.bad, r.known) for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"),
                                                                   support=0.05, pages=3, confidence=0.3).collect()}
    assert got
    for rule, (bad, known) in got.items():
        inside = [b for t, b in rows if set(rule) <= set(t)]
        assert (bad, known) == (sum(inside), len(inside))


def test_segments_are_the_maximal_ones():
    def brute(scores):
        if not scores:
            return []
        best, at = 0, None
        for i in range(len(scores)):
            for j in range(i, len(scores)):
                total = sum(scores[i:j + 1])
                if total > best + 1e-12:
                    best, at = total, (i, j)
        if at is None:
            return []
        i, j = at
        return brute(scores[:i]) + [(best, i, j)] + [(s, a + j + 1, b + j + 1) for s, a, b in brute(scores[j + 1:])]

    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-0.5, 1.013, 2.2571, -3.0091]) if rng.random() < 0.6 else -0.5 for _ in range(rng.randint(0, 14))]
        marked = [(i, s) for i, s in enumerate(scores) if s != -0.5]
        got = toxicity.segments(marked, -0.5)
        assert [round(s, 6) for s, _, _ in got] == [round(s, 6) for s, _, _ in brute(scores)], scores


def test_toxic_texts_are_told_from_clean_ones(spark):
    rng = random.Random(8)
    plain, bad = [f"word{c}{d}" for c in "abcdefgh" for d in "klmnop"], ["vileness", "scumbag", "wretchen"]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(plain, k=rng.randint(20, 80))
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append(" ".join(text))
        labels.append((i + 1, 1, int(toxic)))
    rows += [None, "", " "]
    df, marks = docs(spark, rows).withColumn("label", F.lit("clash")), spark.createDataFrame(labels + [(3, 1, None)], LABELS)
    held = lambda c: fold_is(c, 4, 2)
    model = toxicity.fit(df.repartition(3), marks, held)
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert len(out) == len(rows)
    right = sum((out[i].score >= toxicity.THRESHOLD) == bool(t) for i, _, t in labels)
    assert right >= 0.97 * len(labels)
    assert out[601].score == out[602].score == out[603].score < toxicity.THRESHOLD
    none = toxicity.fit(df, spark.createDataFrame([], LABELS), held)
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.0}
