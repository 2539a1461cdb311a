"""Fill-in-the-middle transformation by repeated-capture matching.

One ``fullmatch`` of ``(unit)*`` keeps every repetition of the group, so ``ends(1)`` of that single match
is the list of unit ends: its length is n, and two look-ups in it are both cut offsets.  The quantifiers are
possessive, as a unit is never given back, and time is linear in the text.  The random numbers of a row are
columns over its id, computed by Spark; only the text and those numbers go through the function, so the id stays
untouched.  One pass, no shuffle.

Defined cases: a null text is the empty one; an empty text, or one that holds a sentinel, stays plain; white space
alone is one unit; a null id draws as the empty id would; repeated rows are cut each, all alike; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import ship

# The sentinels before prefix, suffix and middle, and the unit a text is cut between.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")


def unit_ends(text: str) -> list[int]:
    """Where each unit of the text ends, in code points."""
    return UNITS.fullmatch(text).ends(1)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that depend on seed and id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def form_of(text: str, h3: int, h4: int, rate: int, spm_rate: int) -> str:
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return "plain"
    return "spm" if h4 % 100 < spm_rate else "psm"


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50,
              spm_rate: int = 80) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and output of every row; ``rate`` per cent are cut, ``spm_rate`` of these to spm."""
    ship(docs.sparkSession)

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        rows = []
        for value, a, b, c, d in zip(texts.to_pylist(), *(h.to_pylist() for h in (h1, h2, h3, h4))):
            whole = value or ""
            ends = [0, *unit_ends(whole)]
            form = form_of(whole, c, d, rate, spm_rate)
            if form == "plain":
                rows.append((len(ends) - 1, form, None, None, whole))
                continue
            first, second = sorted((ends[a % len(ends)], ends[b % len(ends)]))
            prefix, middle, suffix = whole[:first], whole[first:second], whole[second:]
            order = (SUFFIX, suffix, PREFIX, prefix) if form == "spm" else (PREFIX, prefix, SUFFIX, suffix)
            rows.append((len(ends) - 1, form, first, second - first, "".join([*order, MIDDLE, middle])))
        n, forms, prefixes, middles, outputs = zip(*rows) if rows else ([],) * 5
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
             pa.array(middles, pa.int64()), pa.array(outputs, pa.string())],
            names=["n", "form", "prefix_chars", "middle_chars", "output"])

    named = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return (named.select("id", cut("text", *draws(F.col("id"), seed)).alias("cut"))
            .select(F.col("id").alias(id_col), "cut.*"))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of.  A cut text holds no sentinel, so each stands in its output once."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    after = lambda whole, mark: F.substr(whole, F.lit(1 + len(mark)))
    psm = F.concat(after(F.substring_index(head, SUFFIX, 1), PREFIX), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, after(F.substring_index(head, PREFIX, 1), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
