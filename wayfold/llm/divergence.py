"""Source divergence audit by count-cell ranking.

How far a source's use of words lies from its language and from every other source of that language.  Add-one
shares p and q in billionths, f = (p - q)^2 / q rounded down, all in whole numbers: decimals where a product could
pass 64 bits.

A term's value depends on its two counts alone.  So terms are first grouped to cells of (count here, count there)
with the number of terms in each, and f is evaluated once per cell, not once per term:

* ``term``: cells of (group count, language count) with equal values are merged to levels, levels are ranked by
  the number of terms above them, and only those that come into the first ``top`` ranks are expanded to their terms,
  in UTF-8 order.
* ``pair``: a term's share depends on its count in a source alone, so terms of one source are cells of equal count;
  only terms of both sources meet, by one join on the term, and are summed where they meet.  One row per pair
  of sources of a language is the result itself.

Texts are cut where they lie; a task counts terms per group in bounded memory before anything moves, and from then
on only (group, term, count) rows do.  No key holds more rows than there are sources, cells are few, and the
expansion is salted.

Defined cases: null text, language and source are empty strings; a group without terms, or a language without kept
terms, still has its pairs (0 where nothing is kept); equal rows are documents each; ids are not read; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import BROADCAST, byte_table, map_arrow, meet
from wayfold.session import materialize

#: Distinct terms a task holds before it hands its counts on.
HELD = 300_000
UNIT = 1_000_000_000
TERMS = byte_table(b"abcdefghijklmnopqrstuvwxyz")


def term_counts(docs: DataFrame, held: int | None = None) -> DataFrame:
    """(lang, source, term, n, docs): counts of a task's texts, each key once per ``held`` distinct terms."""
    held = held or HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
                terms = text.translate(TERMS).split()
                if not terms:
                    continue
                n, within = groups.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(terms)
                within.update(set(terms))
                size += len(n)
                if size >= held:
                    yield _batch(groups)
                    groups, size = {}, 0
        if groups:
            yield _batch(groups)

    return map_arrow(docs.select("text", "lang", "source"), run, "lang string, source string, term string, n long, docs long")


def _batch(groups: dict) -> pa.RecordBatch:
    langs, sources, terms, counts, docs = [], [], [], [], []
    for (lang, source), (n, within) in groups.items():
        langs += [lang] * len(n)
        sources += [source] * len(n)
        terms += n.keys()
        counts += n.values()
        docs += [within[t] for t in n]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()),
                                       pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()),
                                       pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def share(n: str, total: str, kinds: str) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kinds)); nothing kept has no share."""
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0)) div nullif(CAST({total} + {kinds} AS DECIMAL(20,0)), 0)")


def gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts above 0 of the terms in at least ``least`` documents of the language."""
    found = (term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source")
             .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    of_term = Window.partitionBy("lang", "term")  # as many rows as the term has sources
    return (found.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term),
                               "first": F.min("source").over(of_term) == F.col("source")})
            .where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n", "first"))


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, kinds) of every group that occurs."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("lang_total"),
                                       F.coalesce(F.sum("firsts"), F.lit(0)).alias("kinds"))
    return groups.join(langs, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "lang_total", "kinds")


def term_ranks(kept: DataFrame, totals: DataFrame, top: int, most: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms a source uses more than its language, the first ``top``."""
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("terms")).join(totals, ["lang", "source"])
    cells = materialize(cells.withColumns({"p": share("n", "total", "kinds"), "q": share("lang_n", "lang_total", "kinds")})
                        .where("p > q").withColumn("value", gap("p", "q"))
                        .select("lang", "source", "n", "lang_n", "terms", "value"), "term-cells")
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    above = F.coalesce(F.sum("terms").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = (cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
              .withColumn("level", F.row_number().over(down)).where(F.col("level") <= top)  # a level has a term at least
              .withColumn("above", above).where(F.col("above") < top).select("lang", "source", "value", "above"))
    chosen = materialize(cells.join(levels, ["lang", "source", "value"]).drop("terms"), "chosen-cells")
    terms = meet(kept.select("lang", "source", "term", "n", "lang_n"), chosen, ["lang", "source", "n", "lang_n"], most)
    in_level = Window.partitionBy("lang", "source", "value").orderBy("term")
    return (terms.withColumn("place", F.row_number().over(in_level)).where(F.col("place") <= top)
            .withColumn("rank", (F.col("above") + F.col("place")).cast("int")).where(F.col("rank") <= top)
            .select("lang", "source", F.col("term").alias("item"), "value", "rank"))


def pair_ranks(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language by its distance.

    With p0 and q0 for a count of 0, the sum over all kept terms is V f(p0, q0), plus f(p, q0) - f(p0, q0) over the
    terms of the one source, plus f(p0, q) - f(p0, q0) over those of the other, both by cells of equal count, plus
    what the terms of both change in that.  Shares of a group sum to at most UNIT + V, so all sums fit 64 bits.
    """
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q}) div {q})"
    none = totals.withColumn("p0", share("0", "total", "kinds")).select("lang", "source", "total", "kinds", "p0")
    counts = materialize(kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")).join(none, ["lang", "source"])
                         .withColumn("p", share("n", "total", "kinds")).select("lang", "source", "n", "terms", "p", "p0"), "source-cells")
    pairs = materialize(none.drop("total").join(none.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang")
                        .where("source <> item"), "source-pairs")
    parted = kept.select("lang", "term", "source", "n").join(counts.drop("terms"), ["lang", "source", "n"])
    a, b = (parted.select("lang", "term", *(F.col(c).alias(f"{c}{k}") for c in ("source", "p", "p0"))) for k in (1, 2))
    change = lambda p, q, p0, q0: F.expr(f"{f(p, q)} - {f(p, q0)} - {f(p0, q)} + {f(p0, q0)}")
    both = (a.join(b, ["lang", "term"]).where("source1 < source2").groupBy("lang", "source1", "source2")
            .agg(F.sum(change("p1", "p2", "p01", "p02")).alias("up"), F.sum(change("p2", "p1", "p02", "p01")).alias("down")))
    both = both.select("lang", F.inline(F.array(
        F.struct(F.col("source1").alias("source"), F.col("source2").alias("item"), F.col("up").alias("value")),
        F.struct(F.col("source2").alias("source"), F.col("source1").alias("item"), F.col("down").alias("value")))))
    here = pairs.join(counts.drop("p0"), ["lang", "source"]).select(
        "lang", "source", "item", F.expr(f"terms * ({f('p', 'q0')} - {f('p0', 'q0')})").alias("value"))
    there = pairs.join(counts.select("lang", F.col("source").alias("item"), "terms", F.col("p").alias("q")), ["lang", "item"]).select(
        "lang", "source", "item", F.expr(f"terms * ({f('p0', 'q')} - {f('p0', 'q0')})").alias("value"))
    rest = pairs.select("lang", "source", "item", F.expr(f"CASE WHEN kinds > 0 THEN kinds * {f('p0', 'q0')} ELSE 0 END").alias("value"))
    sums = both.unionByName(here).unionByName(there).unionByName(rest).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", rank).select("lang", "source", "item", "value", "rank")


def audit(docs: DataFrame, top: int = 200, least: int = 3, text: str = "text", lang: str = "lang", source: str = "source",
          most: int = BROADCAST) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                         for c, name in ((text, "text"), (lang, "lang"), (source, "source"))))
    kept = materialize(kept_terms(docs, least), "kept-terms")
    totals = materialize(group_totals(docs, kept), "group-totals")
    pairs, terms = pair_ranks(kept, totals), term_ranks(kept, totals, top, most)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("part", F.lit("pair")).select(*columns)
            .unionByName(terms.withColumn("part", F.lit("term")).select(*columns)))
