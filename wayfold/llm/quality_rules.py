"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` adds the counts of a text, ``compile_rules`` turns the rows of the threshold
table into one array expression that names every rule a text fails, and ``judge`` applies
both.  No shuffle: each row is judged where it is read.

Defined cases: a null or blank text has no words and fails on length; a text without lines
that hold a word has no line ratios, and such a rule is then passed; repeated rows are
judged each on its own; extra columns of the input are kept, but for columns with the
names written here, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import SPACE_CHARACTERS, ascii_lower, words

# Symbol characters, and frequent function words of the four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in a is that it for as with was on by be this are from at or an have not they which but "
    "de la le et les des un une du en que est pour dans qui sur au avec par pas plus ce il "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es "
    "el los las del y por con para su al lo como más pero sus").split()


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must lie in [low, high]; a missing bound is open, a zero denominator passes."""
    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None

    def broken(self) -> Column:
        value = F.col(self.numerator).cast("double")
        known = F.lit(True)
        if self.denominator:
            below = F.col(self.denominator)
            known = below > 0
            value = value / F.when(known, below.cast("double"))
        parts = [F.lit(False)]
        if self.low is not None:
            parts.append(value < self.low)
        if self.high is not None:
            parts.append(value > self.high)
        outside = parts[0]
        for part in parts[1:]:
            outside = outside | part
        return known & F.coalesce(outside, F.lit(False))


#: The base thresholds come first; a text that breaks one of them is out whatever else holds.
BASE_RULES = (
    Rule("too_few_words", "n_words", None, low=50),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=0.5),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("few_stop_words", "n_stop_words", None, low=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
)


def _removed(text: Column, characters: str) -> Column:
    """How many characters of a text are of the given ones."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words and line shapes.

    Windows of three words are sorted with their place in the text, so that equal ones
    stand side by side; the words in such windows are counted once each.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumns({"__w": words(F.col(text)),
                             "__l": F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    w = F.col("__w")
    step = step.withColumn("__s", F.sort_array(F.when(F.size(w) >= 3, F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))))
    s = F.col("__s")
    step = step.withColumn("__p", F.filter(
        F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["t"] == x["t"]) | (F.get(s, k + 1)["t"] == x["t"]), x["i"])),
        lambda x: x.isNotNull()))
    lines = F.col("__l")
    out = step.withColumns({
        "n_words": _size(w),
        "word_chars": (F.length(whole) - _removed(whole, SPACE_CHARACTERS)).cast("long"),
        "n_symbols": _removed(whole, SYMBOLS).cast("long"),
        "n_lines": _size(lines),
        "n_dup_lines": _size(lines) - _size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(_size(F.array_distinct(F.flatten(F.transform(
            F.col("__p"), lambda p: F.array(p, p + 1, p + 2))))), F.lit(0)).cast("long"),
        "n_stop_words": _size(F.filter(w, lambda x: ascii_lower(x).isin(STOP_WORDS))),
        "n_cut_lines": _size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
        "n_bullet_lines": _size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣]")))})
    return out.drop("__w", "__l", "__s", "__p")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One expression: the names of the rules that a row breaks, in the table's order."""
    return F.filter(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measures`` plus base_failed, broken_rules and kept."""
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | rule.broken()
    out = measures(docs, text).withColumns({"base_failed": base, "broken_rules": compile_rules((*BASE_RULES, *rules))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    # the measures stand beside a struct of the row, so no column of the input is lost
    judged = judge(docs.select(F.struct("*").alias("__row"), F.col(text).alias("text")), "text", rules)
    # the running number keeps the filter above the measures: pushed below, it would repeat them inside its condition
    return (judged.select("__row", "kept", F.monotonically_increasing_id().alias("__number"))
            .where("kept AND __number >= 0").select("__row.*"))
