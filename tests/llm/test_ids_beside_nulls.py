"""Ids of 64 bits come back exactly, also where a null id or text stands in the same batch."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wayfold.llm import bpe, fill_middle, jaccard_join, leakage, ngram_model, queries, secret_formats, toxicity
from wayfold.llm.common import fold_is
from tests.llm.helpers import written

PATH = public_tokenizers.path("word_bpe_49k.json")
IDS = [9007199254740993, None, 9007199254740995, -9223372036854775807, 2**62 + 1, None, 3]
TEXTS = ["one two three four five six", "a text without an id", None, "one two three four five six", "", "password=abc123XYZ", "seven eight nine"]


def scored(df):
    return ngram_model.score(df, fold_is(F.col("doc_id"), 7, 2))


RUNS = {
    "op1": scored, "op5 ids": lambda df: bpe.encode(df, PATH), "op5 digests": lambda df: bpe.digests(df, PATH),
    "op6": lambda df: toxicity.score(df, toxicity.Model({"x": 1.0})), "op9": secret_formats.find_secrets,
    "op10": jaccard_join.near_duplicates, "op11": fill_middle.transform,
    "op12": lambda df: leakage.leaks(df, df.select(F.col("doc_id").alias("item_id"), "text")),
}


@pytest.mark.parametrize("name", RUNS)
def test_ids_are_not_rounded(spark, name):
    df = spark.createDataFrame(list(zip(IDS, TEXTS)), "doc_id long, text string").coalesce(1)
    out = RUNS[name](df)
    assert dict(out.dtypes)["doc_id"] == "bigint"
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(IDS)


def test_the_smallest_id_of_a_group_is_exact(spark):
    df = spark.createDataFrame(list(zip(IDS, TEXTS)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(df).collect()}
    assert got[9007199254740993] == got[-9223372036854775807] == -9223372036854775807 and got[2**62 + 1] == 2**62 + 1


def test_the_toxic_query_keeps_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(IDS, TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(IDS)], "doc_id long, quality int, toxic int")
    root = written({"documents": df.coalesce(1), "labels": labels}, tmp_path)
    assert Counter(r.doc_id for r in queries.op6_toxic_segments(spark, root).collect()) == Counter(IDS)
