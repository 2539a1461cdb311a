"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, token ids and back.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as
Parquet and read again as the next stage's documents.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import bpe, jaccard_join, line_spread, mixing, quality_rules
from wayfold.llm.common import WORD, table
from wayfold.llm.queries import vocabulary_path
from wayfold.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; so does a document of which nothing else is left, as all its lines stand elsewhere."""
    cut = line_spread.remove_boilerplate(docs)
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                           .otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by near copies (five words, 0.8) the one of smallest id stays; equal rows once."""
    groups = jaccard_join.near_duplicates(docs, width=5, percent=80)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    nameless = docs.where(F.col("doc_id").isNull())  # no id to tell them apart by: they stay
    return docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns).unionByName(nameless)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, dropped or repeated up to three times, so that each source's words come to its target."""
    return mixing.shuffled(mixing.mix(docs, whole=True), docs.columns).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text they decode to, of every row of the mix."""
    return bpe.encode(docs, vocabulary_path(), decoded=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("mixing to target weights", mixture), ("BPE encoding and decoding", tokens)]
#: No SQL: token ids are not expressible; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
