import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from wayfold.llm import queries
from wayfold.llm.quality_rules import STOP_WORDS
from tests.llm.helpers import DOCS, docs, words, written
from tests.llm.test_joins_lm import brute_groups

REPO = Path(entry.__file__).resolve().parent


def corpus():
    rng = random.Random(11)
    line = "this page was printed from the archive of the site"
    texts, sources = [], []
    for i in range(60):
        text = " ".join(rng.choices(STOP_WORDS[:30] + [f"plain{k}" for k in range(300)], k=120))
        texts.append(f"{text}\n{line}" if i % 3 == 0 else text)
        sources.append(f"s{i % 13}")
    for i in range(0, 60, 6):
        texts.append(texts[i].replace("plain1 ", "other "))
        sources.append("s1")
    return texts + [None, "", "too short", "buy ### now *** " * 40], sources + ["s1", None, "s2", "s3"]


def test_stages_do_what_they_say(spark, tmp_path):
    texts, sources = corpus()
    df = docs(spark, texts, sources)
    root = written({"documents": df}, tmp_path)
    now, after = df, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, root)
        assert k + 1 == len(corpus_pipeline.STAGES) or out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        after.append(now.collect())
    kept, cut, single, mixed, encoded = after
    assert {r.doc_id for r in kept} == set(range(1, 71))
    with_line = [r for r in cut if "printed from" in r.text]
    assert len(with_line) == 1 and len(cut) == len(kept) and all(r.n_chars == len(r.text) for r in cut)
    groups = brute_groups([r.text for r in sorted(cut, key=lambda r: r.doc_id)], 5, 80)
    assert sorted(r.doc_id for r in single) == sorted({g for _, g in groups})
    size = Counter()
    for r in mixed:
        size[r.source] += len(words(r.text))
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in single}
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    library = Tokenizer.from_file(queries.vocabulary_path())
    by_id = {r.doc_id: r.text for r in single}
    assert len(encoded) == len(mixed)
    for r in encoded:
        assert r.ids == library.encode(by_id[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, root).collect()) == sorted(r.doc_id for r in encoded)


def test_stages_take_nothing(spark, tmp_path):
    now = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0


def test_entry_without_the_subpackage(tmp_path):
    code = ("import sys; sys.modules['wayfold.llm'] = None; import __spark_entry__ as e; "
            "q = e.queries(); assert q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); assert e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


@pytest.mark.parametrize("n", range(1, 14))
def test_one_query_per_operator(n):
    assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1
