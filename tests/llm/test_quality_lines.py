from wayfold.llm.line_spread import remove_boilerplate
from wayfold.llm.quality_rules import judge, keep_good
from tests.llm.helpers import DOCS, docs

GOOD = " ".join(f"the word{i} of plain{i}" for i in range(20))


def repeats(text):
    w = (text or "").split()
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    return len({p for i, t in enumerate(windows) if windows.count(t) > 1 for p in (i, i + 1, i + 2)})


def test_quality_counts_and_verdicts(spark):
    texts = [GOOD, "a b c a b c a b", "to " * 80, None, "", " \n\t ", GOOD + "\n" + "* " * 40, "x\nx\nx\n\n y", GOOD.upper(),
             GOOD + " a b c a b c", "é " * 60]
    rows = {r.doc_id: r for r in judge(docs(spark, texts)).collect()}
    for i, t in enumerate(texts, 1):
        assert rows[i].n_words == len((t or "").split())
        assert rows[i].n_repeat_words == repeats(t), t
        assert rows[i].word_chars == sum(map(len, (t or "").split()))
    assert rows[7].n_symbols == 40 and not rows[7].kept and "symbols" in rows[7].broken_rules
    assert rows[8].n_dup_lines == 2 and rows[8].n_lines == 4
    assert rows[1].kept and rows[9].kept and rows[10].kept
    assert [rows[i].base_failed for i in (2, 3, 4, 5, 6)] == [True] * 5
    assert "stop_words" in rows[11].broken_rules


def test_keep_good_keeps_columns_that_clash(spark):
    df = docs(spark, [GOOD, "short"]).selectExpr("*", "7 AS n_words", "'x' AS kept", "1 AS __w")
    out = keep_good(df)
    assert out.columns == df.columns
    assert [(r.doc_id, r.n_words, r.kept) for r in out.collect()] == [(1, 7, "x")]
    assert keep_good(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_on_many_sites_stay_once(spark):
    line = "all rights are reserved here"
    texts = [f"own text number {i}\n  {line} \n{line} again {i}" for i in range(6)] + [None, "", line, f"{line}\n{line}", "too short"]
    out = {r.doc_id: r for r in remove_boilerplate(docs(spark, texts, [f"s{i % 6}" for i in range(9)] + [None, "s0"]), min_sites=4).collect()}
    assert out[1].text == texts[0] and out[1].n_removed == 0
    assert all(out[i].text == f"own text number {i - 1}\n{line} again {i - 1}" and out[i].n_removed == 1 for i in range(2, 7))
    assert out[7].text is None and out[7].n_lines == 0 and out[8].text == "" and out[9].text == ""
    assert out[10].n_removed == 2 and out[11].text == "too short"
    below = remove_boilerplate(docs(spark, texts, ["s0", "s1", "s2"] * 3 + [None, "s0"]), min_sites=5)
    assert below.agg({"n_removed": "sum"}).first()[0] == 0
    assert remove_boilerplate(spark.createDataFrame([], DOCS)).count() == 0


def test_short_lines_and_repeated_rows(spark):
    rows = [(1, "ok then", f"s{i}") for i in range(20)] + [(2, "a line of words", f"s{i}") for i in range(20)]
    out = remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=10).collect()
    assert {(r.doc_id, r.text, r.n_removed) for r in out} == {(1, "ok then", 0), (2, "a line of words", 0)}
    assert len(out) == 40


def test_rows_with_null_ids_take_part(spark):
    head = "all rights are reserved here"
    rows = [(i, f"{head}\nown text number {i}", f"s{i}") for i in range(1, 13)]
    rows += [(None, f"{head}\nown text without id", "t0"), (None, f"other first line here\n{head}\nlast line of it", "t1"), (None, None, "t2")]
    schema = "doc_id long, text string, source string"
    out = remove_boilerplate(spark.createDataFrame(rows, schema).repartition(3), min_sites=10).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.text, r.n_removed) for r in out if r.doc_id} == {
        i: (f"{head}\nown text number {i}", 0) if i == 1 else (f"own text number {i}", 1) for i in range(1, 13)}
    assert sorted((str(r.text), r.n_removed) for r in out if r.doc_id is None) == [
        ("None", 0), ("other first line here\nlast line of it", 1), ("own text without id", 1)]
    alone = [(None, f"{head}\nown text number {i}", f"s{i}") for i in range(12)]
    out = remove_boilerplate(spark.createDataFrame(alone, schema), min_sites=10).collect()
    assert sorted(r.n_removed for r in out) == [0] + [1] * 11 and sum(head in r.text for r in out) == 1
