import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import divergence, fill_middle, leakage, queries
from wayfold.llm.common import meet
from wayfold.session import materialize
from tests.llm.helpers import DOCS, LOWER, docs, written

SIGNS = ["a", "bc", "Été", "中文", "<P>", "<S", "M>", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x85", " ", "x" * 50]
CLASHING = ["n", "form", "row", "name", "found", "group", "items", "term", "total", "p", "id", "hash"]


def with_clashes(df):
    """The table with columns named like the operators' own."""
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- fill-in-middle

def cut_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_unit_ends_are_those_of_repeated_searches():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choices(SIGNS, k=rng.randint(0, 30)))
        assert fill_middle.unit_ends(text) == [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]


def test_fill_middle_equals_cutting_by_hand(spark):
    rng = random.Random(4)
    rows = [(2**53 + 1 + 2 * i, "".join(rng.choices(SIGNS, k=rng.randint(0, 30)))) for i in range(400)]
    rows += [(None, "a null id stands beside large ones"), (1, None), (2, ""), (3, " \n"), (4, "word"), (4, "word"),
             (5, "long " * 60_000), (6, "y" * 200_000), (None, None)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    out = fill_middle.transform(df)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    wanted = Counter((i, *cut_by_hand(i, t), t or "") for i, t in rows)
    assert Counter(tuple(r) for r in got) == wanted
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_rates_and_empty_table(spark):
    df = docs(spark, ["one two three four"] * 50)
    assert {r.form for r in fill_middle.transform(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_middle.transform(df, rate=100, spm_rate=0).collect()} == {"psm"}
    assert {r.form for r in fill_middle.transform(df, rate=100, spm_rate=100).collect()} == {"spm"}
    assert fill_middle.transform(spark.createDataFrame([], DOCS)).count() == 0


# ---------------------------------------------------------------- benchmark leaks

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(LOWER))


def leaks_by_hand(texts, items):
    windows = defaultdict(set)
    for name, text in items:
        w = item_words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i:i + size])].add("" if name is None else str(name))
    sizes = {len(k) for k in windows}
    out = []
    for text in texts:
        w, hit, names = item_words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i:i + size]))
                if found:
                    names |= found
                    hit.update(range(i, i + size))
        out.append((len(w), frozenset(hit), tuple(sorted(names))))
    return out


def leaky(rng):
    words = [f"w{k}" for k in range(60)] + ["Über", "naïve", "中文", "x1"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, text(rng.randint(10, 40))) for k in range(25)]
    shared = text(14)
    items += [(100 + k, f"{shared} {text(12)}") for k in range(12)]  # a passage of many items
    items += [(200, "only three words"), (201, "Single"), (202, text(9)), (203, text(10)), (204, items[0][1]), (None, text(15)), (205, ""),
              (206, None), (2, text(20)), (207, "a b " * 10)]
    texts = []
    for k in range(120):
        part = items[rng.randrange(len(items))][1] or ""
        w = part.split()
        a = rng.randint(0, max(0, len(w) - 1))
        piece = " ".join(w[a:a + rng.randint(5, 30)])
        texts.append(f"{text(rng.randint(0, 40))} {piece.upper() if k % 3 else piece.replace(' ', ', ')}\n{text(rng.randint(0, 20))}")
    texts += [f"{text(5)} {shared} {text(5)}"] * 30  # a passage of many documents
    texts += [None, "", " \n", "only, three WORDS", "single", "a b " * 40, text(3), "b a " * 30]
    return texts, items


@pytest.mark.parametrize("most", [1 << 17, 0])
def test_leaks_equal_brute_force(spark, most):
    rng = random.Random(9)
    texts, items = leaky(rng)
    ids = [None if i == 7 else 1 if i in (8, 9) else 2**53 + 1 + 2 * i for i in range(len(texts))]
    df = with_clashes(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).repartition(3)
    bench = with_clashes(spark.createDataFrame(items, "item_id long, text string")).repartition(2)
    got = leakage.leaks(df, bench, most=most).collect()
    spans = lambda r: frozenset(p for s in r.spans for p in range(s.start, s.end))
    assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))
    assert (Counter((r.doc_id, r.n_words, r.n_hit, spans(r), tuple(r["items"])) for r in got)
            == Counter((i, n, len(hit), hit, names) for i, (n, hit, names) in zip(ids, leaks_by_hand(texts, items))))


def test_every_window_keeps_a_gram_and_the_same_in_both_texts():
    rng = np.random.default_rng(5)
    for _ in range(300):
        codes = rng.integers(0, 4, rng.integers(10, 60)).astype(np.uint64)  # few words: many equal hashes
        hashes = leakage.grams(codes, leakage.GRAM, leakage.WINDOW)
        kept = leakage.winnowed(hashes, leakage.WINDOW - leakage.GRAM + 1)
        for start in range(len(codes) - leakage.WINDOW + 1):
            alone = leakage.winnowed(leakage.grams(codes[start:start + leakage.WINDOW], leakage.GRAM, leakage.WINDOW), 6)
            assert len(alone) == 1 and start + alone[0] in kept


def test_leaks_of_empty_tables_and_long_texts(spark):
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "x y z " * 5)], "item_id long, text string")
    df = docs(spark, ["x y z " * 30_000, "q" * 300_000, None])
    assert [(r.n_hit, r.spans, r["items"]) for r in leakage.leaks(df, none).collect()] == [(0, [], [])] * 3
    assert leakage.leaks(spark.createDataFrame([], DOCS), some).count() == 0
    got = {r.doc_id: r for r in leakage.leaks(df, some).collect()}
    assert got[1].n_hit == 90_000 and len(got[1].spans) == 1 and got[1]["items"] == ["1"] and got[2].n_hit == 0


def test_meet_is_the_inner_join_either_way(spark):
    many = spark.range(2000).selectExpr("id % 3 AS k", "id")
    few = materialize(spark.range(2).selectExpr("id AS k", "id * 10 AS v"), "few")
    wanted = sorted(map(tuple, many.join(few, "k").collect()))
    for most in (10, 1):
        assert sorted(map(tuple, meet(many, few, ["k"], most).collect())) == wanted


# ---------------------------------------------------------------- source divergence

def audit_by_hand(rows, top=200, least=3):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, groups, within = defaultdict(Counter), set(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(words)
        within[lang].update(set(words))
    share = lambda c, n, v: 1 + 10**9 * (c + 1) // (n + v)
    gap = lambda p, q: (p - q) ** 2 // q
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in within[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        every = sum(total.values())
        p = {s: [share(counts[lang, s][t], total[s], len(kept)) for t in kept] for s in sources}
        q = [share(whole[t], every, len(kept)) for t in kept]
        for s in sources:
            pairs = [(-sum(map(gap, p[s], p[o])), o.encode(), o) for o in sources if o != s]
            terms = [(-gap(a, b), t.encode(), t) for t, a, b in zip(kept, p[s], q) if counts[lang, s][t] and a > b]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out |= {(lang, s, part, x[2], -x[0], k) for k, x in enumerate(sorted(found)[:most], 1)}
    return out


def sources_corpus(rng):
    rows = []
    for k in range(200):
        lang = rng.choice(["en", "de", None])
        source = rng.choice(["a", "b", "b", "b", "ç", None])
        low = 10 * (ord((source or "z")[0]) % 5)
        words = [f"{rng.choice(['Term', 'é', '中'])}{'abcdefghij'[x % 10]}{'klmno'[x // 10]}" for x in
                 (min(49, low + int(rng.expovariate(0.1))) for _ in range(rng.randint(0, 40)))]
        rows.append((rng.choice([" ", "-", "7"]).join(words), lang, source))
    rows += [(None, "en", "a"), ("", "fr", "a"), ("rare words", "fr", "b"), ("x", "xx", "alone"), ("9 8 7", "en", "no terms")]
    return rows + rows[:20]


@pytest.mark.parametrize("top, held, most", [(200, 300_000, 1 << 17), (3, 40, 0), (1, 1, 0)])
def test_audit_equals_brute_force(spark, monkeypatch, top, held, most):
    rows = sources_corpus(random.Random(2))
    monkeypatch.setattr(divergence, "HELD", held)
    df = with_clashes(spark.createDataFrame(rows, "text string, lang string, source string")).repartition(5)
    got = divergence.audit(df, top=top, most=most).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == audit_by_hand(rows, top)


def test_audit_where_nothing_is_kept(spark):
    rows = [("some words", "en", "a"), ("other words", "en", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert {tuple(r) for r in divergence.audit(df).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    df = spark.range(1).selectExpr("90000000000000000 AS n", "90000000000000007 AS total", "13 AS kinds")
    got = df.select(divergence.share("n", "total", "kinds")).first()[0]
    assert got == 1 + 10**9 * (90000000000000000 + 1) // (90000000000000007 + 13)


def test_the_queries_give_the_contract_columns(spark, tmp_path):
    rows = sources_corpus(random.Random(6))
    table = spark.createDataFrame([(k, t, la, s, 0) for k, (t, la, s) in enumerate(rows)], DOCS)
    bench = spark.createDataFrame([(1, rows[0][0]), (2, rows[5][0])], "item_id long, text string")
    root = written({"documents": table, "benchmark": bench}, tmp_path)
    by_id = {r.doc_id: r for r in queries.op11_fill_middle(spark, root).collect()}
    for k, (text, _, _) in enumerate(rows):
        n, form, prefix, middle, output = cut_by_hand(k, text)
        assert tuple(by_id[k]) == (k, n, form, prefix, middle, sha(output), sha(text or ""))
    hits = {r.doc_id: r for r in queries.op12_benchmark_leaks(spark, root).collect()}
    for k, (n, hit, names) in enumerate(leaks_by_hand([r[0] for r in rows], [(1, rows[0][0]), (2, rows[5][0])])):
        assert tuple(hits[k]) == (k, n, len(hit), len(names), sha(",".join(names)), bool(hit))
    assert {tuple(r) for r in queries.op13_source_divergence(spark, root).collect()} == audit_by_hand(rows)
