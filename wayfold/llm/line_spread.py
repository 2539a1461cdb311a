"""Line dedup by distinct-site spread, in DataFrame functions only.

A line is boilerplate when it stands on at least ``min_sites`` different sites.  Sketches
of the sites of each line (HyperLogLog, merged by partial aggregation, so a line on a
third of all documents is one small sketch per task before the shuffle) split the lines in
three: clearly below, clearly above, and near the threshold.  Only the near ones get an
exact distinct count, also by partial aggregation.  The first copy of a boilerplate line,
by (document id, place), stays; the others go.

Only narrow rows (two hashes of the line, document, place) move to find the lines to
remove; the texts move at most once, to meet the places to remove.

Defined cases: a line is a part between line feeds, compared without blanks at its ends;
lines of fewer than ``min_words`` words are left alone; a null text stays null, an empty
one empty, a text that loses every line becomes empty; a null site counts as one site; rows
with the same id share its places: repeated rows are equal copies and are cut alike (give
rows with the same id but other texts a different id); rows with a null id are known by their text
instead, so equal ones are cut alike, and come last: a line's copy stays in one of them only where no row
with an id has the line; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import SPACE_CHARACTERS, WORD

#: log2 of the sketch's registers; its relative error is 1.04 / sqrt(2^LG_K), about 3.3 %.
LG_K = 10
ERROR = 1.04 / 2 ** (LG_K / 2)
#: The near band spans so many standard errors on each side of the threshold.
WIDTH = 6


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARACTERS))


def _nameless(id_col: str, text: str) -> Column:
    return F.when(F.col(id_col).isNull(), F.md5(F.col(text))).otherwise("")


def line_rows(docs: DataFrame, id_col: str, text: str, site: str, min_words: int) -> DataFrame:
    """doc, nameless (a key of the text where doc is null), place, site and a 128-bit key of each line that may be boilerplate."""
    flat = docs.select(F.col(id_col).alias("doc"), _nameless(id_col, text).alias("nameless"), F.coalesce(F.col(site).cast("string"), F.lit("\0none")).alias("site"),
                       F.posexplode(F.split(F.col(text), "\n", -1)).alias("place", "raw"))
    flat = flat.withColumn("line", _trimmed(F.col("raw"))).where(F.regexp_count("line", F.lit(WORD)) >= min_words)
    return flat.select("doc", "nameless", "place", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """The keys of boilerplate lines with the document and place of the copy that stays."""
    low, high = min_sites * (1 - WIDTH * ERROR), min_sites * (1 + WIDTH * ERROR)
    spread = (lines.groupBy("h1", "h2")
              .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"),
                   F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "nameless", "place")).alias("first"))
              .where(F.col("sites") >= low))
    clear = spread.where(F.col("sites") > high).select("h1", "h2", "first")
    near = spread.where(F.col("sites") <= high).select("h1", "h2", "first")
    counted = (lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
               .select("h1", "h2", "site").distinct()
               .groupBy("h1", "h2").count().where(F.col("count") >= min_sites).select("h1", "h2"))
    return clear.unionByName(near.join(counted, ["h1", "h2"], "left_semi"))


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, min_words: int = 3, id_col: str = "doc_id",
                       text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` with ``text`` cut, and n_lines and n_removed added."""
    lines = line_rows(docs, id_col, text, site, min_words)
    found = boilerplate(lines, min_sites)
    gone = (lines.join(found, ["h1", "h2"])
            .where(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("nameless") == F.col("first.nameless"))
                     & (F.col("place") == F.col("first.place"))))
            .groupBy(F.col("doc").alias("__doc"), F.col("nameless").alias("__nameless")).agg(F.collect_set("place").alias("__gone")))  # at most a text's lines
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__doc")) & (_nameless(id_col, text) == F.col("__nameless")), "left")
    parts = F.split(F.col(text), "\n", -1)
    mark = F.coalesce(F.col("__gone"), F.array().cast("array<int>"))
    cut = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    return joined.withColumns({
        "n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("long"),
        "n_removed": F.size(mark).cast("long"),
        text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(cut)}).drop("__doc", "__nameless", "__gone")
