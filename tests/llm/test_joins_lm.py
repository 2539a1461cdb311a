import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import jaccard_join, ngram_model
from wayfold.llm.common import fold_is
from wayfold.llm.components import components
from wayfold.llm.elias_fano import U64, EliasFano, Relative, Trie
from tests.llm.helpers import DOCS, docs, words


def shingle_set(text, width):
    w = words(text)
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_groups(texts, width, percent):
    sets, root = [shingle_set(t, width) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i) + 1) for i, s in enumerate(sets)]


def corpus(seed, bases=25):
    """Near copies at every distance, small sets around each size, a passage many texts share, copies and blanks."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    texts = [None, "", " \n", "one", "one two three", "One TWO three", "a b c d", "a b c d e"]
    for _ in range(bases):
        base = rng.choices(vocabulary, k=rng.choice([5, 7, 9, 10, 12, 15, 16, 17, 20, 22, 25, 40, 90, 150]))
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, heavy, percent, width", [(1, 1 << 18, 85, 4), (2, 40, 85, 4), (3, 5, 80, 5)])
def test_components_equal_brute_force(spark, monkeypatch, seed, heavy, percent, width):
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    texts = corpus(seed)
    df = docs(spark, texts).withColumn("cls", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, width, percent).collect()}
    assert [out[i + 1] for i in range(len(texts))] == brute_groups(texts, width, percent)


def test_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(copy))
    assert {r.component_id for r in jaccard_join.near_duplicates(docs(spark, texts)).collect()} == {1}


def test_join_of_nothing_and_of_null_ids(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e"), (7, "a b c d e"), (3, "a b c d e"), (3, "other words stand here now"), (None, None), (9, "other words stand here now")]
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (0, 0), (3, 3), (3, 3), (7, 3), (9, 3)]


def test_parities_are_no_further_apart_than_their_sets():
    rng = np.random.default_rng(7)
    for n, m, both in [(1, 1, 0), (64, 65, 64), (300, 290, 280), (500, 520, 0), (1000, 900, 850), (130, 64, 3)]:
        codes = rng.integers(0, 1 << 63, n + m - both).astype("uint64")
        x, y = np.unique(codes[:n]), np.unique(codes[n - both:])
        found = jaccard_join.distance(jaccard_join.parity(x), jaccard_join.parity(y))
        assert found <= len(np.setxor1d(x, y)) and (found == 0) == (n + m == 2 * both)


def test_sets_of_pairs_that_meet_by_chance_are_not_sent(spark, monkeypatch):
    """Texts that share a passage and little else meet in its lists; only near copies may go on to the comparison of sets."""
    rng, compared, hold = random.Random(9), [], jaccard_join.materialize
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join(rng.sample([f"w{i}" for i in range(5000)], 60) + passage) for _ in range(60)]
    texts += [texts[0] + " end", texts[1] + " end"]

    def counted(df, label="step"):
        out = hold(df, label)
        if label == "near-pairs":
            compared.extend((r.a, r.b) for r in out.collect())
        return out
    monkeypatch.setattr(jaccard_join, "materialize", counted)
    out = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs(spark, texts)).collect()}
    assert [out[i + 1] for i in range(62)] == [*range(1, 61), 1, 2]
    assert len({frozenset(p) for p in compared}) == 2


def test_small_subsets_cover_every_overlap():
    for n in range(1, 20):
        for m in range(n, 20):
            if 100 * n >= 85 * m and jaccard_join.least_overlap(n, m, 85) <= n:
                o = jaccard_join.least_overlap(n, m, 85)
                assert o in jaccard_join.subset_sizes(n, 85) and o in jaccard_join.subset_sizes(m, 85)
                assert 100 * o >= 85 * (n + m - o) and 100 * (o - 1) < 85 * (n + m - o + 1)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[k] == 100 for k in range(100, 130))


def test_elias_fano_reads_and_searches():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (1, 5), (7, 0), (1000, 10 ** 6), (5000, 40), (3000, 2 ** 50)):
        values = np.sort(rng.integers(0, top + 1, n)).astype(U64)
        e = EliasFano(values)
        assert (e.get(np.arange(n)) == values).all()
        asked = rng.integers(0, top + 2, 300).astype(U64)
        assert (e.find(np.zeros(300, int), np.full(300, n), asked) == np.searchsorted(values, asked)).all()


def test_relative_runs_with_empty_contexts(tmp_path):
    runs = [[3, 9], [], [1], [], [0, 5, 7]]
    starts = np.cumsum([0] + [len(r) for r in runs])
    r = Relative(np.array(sum(runs, []), dtype=U64), starts)
    for c, run in enumerate(runs):
        for w in range(11):
            assert r.find(np.array([c]), np.array([w]), np.array([0]))[0] == (starts[c] + run.index(w) if w in run else -1)
    triples = np.unique(np.random.default_rng(2).integers(0, 20, (500, 3)).astype(U64) @ np.array([1 << 38, 1 << 19, 1], dtype=U64))
    pairs = np.unique(np.concatenate([triples >> U64(19), np.array([5 << 19 | 300], dtype=U64)]))
    none = np.zeros(len(pairs), np.uint8)
    trie = Trie(pairs, triples, 19, none, none, np.zeros(len(triples), np.uint8)).mapped(str(tmp_path))
    assert (trie.pair(pairs) == np.arange(len(pairs))).all() and trie.pair(np.array([7 << 19 | 301], dtype=U64))[0] == -1
    assert (trie.third.find(trie.pair(triples >> U64(19)), triples & trie.mask, np.arange(len(triples))) == np.arange(len(triples))).all()


@pytest.mark.parametrize("chunk, shard, vocabulary", [(1_000_000, 2_000_000, 1 << 18), (300, 500, 1 << 18), (300, 500, 50)])
def test_scores_equal_an_unsharded_model(spark, chunk, shard, vocabulary):
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"W{min(i, j)}" for i in range(20) for j in range(20)], k=rng.randint(1, 60))) for _ in range(150)]
    texts += [None, "", texts[0], "\t a\x0bb \n", "new unseen words"]
    df = docs(spark, texts).withColumn("held", F.lit(5)).withColumn("tokens", F.lit("clash")).repartition(3)
    out = {r.doc_id: r for r in ngram_model.score(df, fold_is(F.col("doc_id"), 7, 2), vocabulary=vocabulary, chunk=chunk, shard=shard).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(1, len(texts) + 1)}
    tokens = {i: [*words(texts[i - 1]), None] for i in held}
    train = [tokens[i] for i in held if not held[i]]
    c1 = Counter(w for t in train for w in t)
    n, v = sum(c1.values()), len(c1)
    many = v <= vocabulary
    c2, c3, x2, x3 = Counter(), Counter(), Counter(), Counter()
    for t in train:
        for a, b, w in zip(["<", "<", *t], ["<", *t], t):
            c3[a, b, w] += 1
            x3[a, b] += 1
            c2[b, w] += 1
            x2[b] += 1
    for i, t in tokens.items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c1[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        if many:
            exact = 0.0
            for a, b, w in zip(["<", "<", *t], ["<", *t], t):
                p = (c2[b, w] + ngram_model.MU2 * (c1[w] + 1) / (n + v + 1)) / (x2[b] + ngram_model.MU2)
                exact += math.log10((c3[a, b, w] + ngram_model.MU3 * p) / (x3[a, b] + ngram_model.MU3))
            assert math.isclose(r.score, exact, rel_tol=0.02)
        assert r.score <= 0


@pytest.mark.parametrize("vocabulary", [0, 1, 60])
def test_every_word_has_ngrams_of_its_own(spark, vocabulary):
    rng = random.Random(11)
    texts = [" ".join(rng.choices([f"w{min(i, j)}" for i in range(20) for j in range(20)], k=30) + [f"rare{i % 40}", f"seldom{i % 40}", "of", f"tail{i % 40}"])
             for i in range(120)]
    texts += ["", None, "never seen", "rare1 seldom2 of tail3", "rare1 seldom1 of tail1"]
    held = {i: i % 5 == 0 or i > 120 for i in range(1, len(texts) + 1)}
    df = docs(spark, texts).repartition(3)
    is_held = (F.col("doc_id") % 5 == 0) | (F.col("doc_id") > 120)
    out = {r.doc_id: r for r in ngram_model.score(df, is_held, vocabulary=vocabulary, chunk=300, shard=500).collect()}
    tokens = {i: [*words(texts[i - 1]), None] for i in held}
    c1, c2, c3, x2, x3 = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, t in tokens.items():
        for a, b, w in zip(["<", "<", *t], ["<", *t], t):
            if not held[i]:
                for c, k in ((c1, w), (c2, (b, w)), (c3, (a, b, w)), (x2, b), (x3, (a, b))):
                    c[k] += 1
    n, v = sum(c1.values()), len(c1)
    assert v > vocabulary
    for i, t in tokens.items():
        exact = 0.0
        for a, b, w in zip(["<", "<", *t], ["<", *t], t):
            p = (c2[b, w] + ngram_model.MU2 * (c1[w] + 1) / (n + v + 1)) / (x2[b] + ngram_model.MU2)
            exact += math.log10((c3[a, b, w] + ngram_model.MU3 * p) / (x3[a, b] + ngram_model.MU3))
        assert math.isclose(out[i].score, exact, rel_tol=0.02), (i, t)


def test_scores_without_training_texts(spark):
    assert ngram_model.score(spark.createDataFrame([], DOCS), F.lit(False)).count() == 0
    out = ngram_model.score(docs(spark, ["a b"]), F.lit(True)).first()
    assert (out.n_tokens, out.n_known, out.train_tokens, out.base_score) == (3, 0, 0, 0.0)
