"""Rules that look around the matches of a text, as Column expressions.

Splitting a text at a pattern gives its gaps, extracting all matches gives what stood
between them; the running length of both is the place of every match, in code points.  A
fold over these pairs keeps only the place reached and what it looks for, so a page with
many matches is walked once and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import text as tx
from wayfold.functions.text import let

PLACE = "struct<start:int,end:int>"
EXCERPT_WIDTH = 180
PRICE_WINDOW = 90


def _place(start: Column, length: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), (start + length).cast("int").alias("end"))


def first_place(text: Column, pattern: str) -> Column:
    """Start and end of the first match, null where there is none.

    What stands before it is the text without the match and all that follows; ``split`` would compile the pattern for each row.
    """
    regex = tx.UNICODE_I + pattern
    gap = F.length(F.regexp_replace(text, tx.UNICODE_I + f"(?:{pattern})(?s:.*)", ""))
    return let(F.length(F.regexp_extract(text, regex, 0)), lambda size: F.when(size > 0, let(gap, lambda start: _place(start, size))))


def fold_matches(text: Column, pattern: str, zero: Column, step, finish) -> Column:
    """Fold all matches in order: ``step(state, place, match)`` gives the next state."""
    regex = tx.UNICODE_I + pattern
    pairs = F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0)),
                       lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    def walk(acc: Column, pair: Column) -> Column:
        place = _place(acc["at"] + F.length(pair["gap"]), F.length(pair["hit"]))
        return F.when(pair["hit"].isNull(), acc).otherwise(let(place, lambda p: F.struct(
            p["end"].alias("at"), step(acc["state"], p, pair["hit"]).alias("state"))))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), zero.alias("state")), walk, lambda acc: finish(acc["state"]))


def around(text: Column, place: Column, width: int = EXCERPT_WIDTH) -> Column:
    """The passage at a place with ``width // 2`` characters of context on each side."""
    def cut(place: Column) -> Column:
        start = F.greatest(F.lit(0), place["start"] - width // 2)
        end = F.least(F.length(text), place["end"] + width // 2)
        return F.when(place.isNotNull(), F.concat(
            F.when(start > 0, F.lit("…")).otherwise(F.lit("")), tx.collapse_space(F.substring(text, start + 1, end - start)),
            F.when(end < F.length(text), F.lit("…")).otherwise(F.lit(""))))
    return let(place, cut)


def is_negated(text: Column, start: Column) -> Column:
    """A denial, a warning or a mention of others, in the same sentence shortly before."""
    size = F.least(start, F.lit(rules.NEGATION_WINDOW))
    sentence = F.regexp_replace(F.substring(text, start - size + 1, size), r"(?s)^.*(?:[.!?] |\n)", "")
    return tx.matches(sentence, rules.NEGATION_CUES)


def first_affirmed(text: Column, pattern: str) -> Column:
    """Place of the first match that is not negated."""
    return fold_matches(text, pattern, F.lit(None).cast(PLACE),
                        lambda found, place, hit: F.when(found.isNotNull(), found).when(~is_negated(text, place["start"]), place),
                        lambda found: found)


def first_per(items: Column, field: str) -> Column:
    """The items without those whose ``field`` an earlier item has."""
    def first(present: Column) -> Column:
        return F.filter(present, lambda x, i: F.array_position(F.transform(present, lambda y: y[field]), x[field]) == i + 1)
    return let(F.array_compact(items), first)


def block_signals(whole: Column, folded: Column | None = None) -> Column:
    """One item per hard-block signal affirmed on a page that makes an offer."""
    def item(signal: str, label: str, pattern: str) -> Column:
        place = F.when(tx.matches(whole, pattern, folded=folded), first_affirmed(whole, pattern))
        return let(around(whole, place), lambda excerpt: F.when(excerpt.isNotNull(), F.struct(
            F.lit(signal).alias("signal"), F.lit(label).alias("label"), excerpt.alias("excerpt"))))
    found = first_per(F.array(*[item(*rule) for rule in rules.HARD_BLOCK_RULES]), "signal")
    none = F.array().cast("array<struct<signal:string,label:string,excerpt:string>>")
    return F.when(tx.matches(whole, rules.OFFER_CONTEXT, folded=folded), found).otherwise(none)


def stated_facts(title: Column, body: Column, folded: Column | None = None) -> Column:
    """One item per fact stated, in the title or else the body, by the first match there."""
    def passage(text: Column, pattern: str, guarded: bool) -> Column:
        place = first_place(text, pattern)
        if guarded:
            place = let(place, lambda p: F.when(~is_negated(text, p["start"]), p))
        return around(text, place)

    def item(field: str, value: bool, label: str, pattern: str, guarded: bool) -> Column:
        excerpt = F.coalesce(passage(title, pattern, guarded), passage(body, pattern, guarded))
        possible = tx.may_match(folded, pattern)
        excerpt = excerpt if possible is None else F.when(possible, excerpt)
        return let(excerpt, lambda x: F.when(x.isNotNull(), F.struct(
            F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit(label).alias("label"),
            x.alias("excerpt"), F.lit(0.7).alias("confidence"))))
    return first_per(F.array(*[item(*rule) for rule in rules.FACT_RULES]), "field")


def stated_prices(text: Column) -> Column:
    """Lowest and highest amount near a pricing word, else a free offer, else null."""
    part = lambda hit, k: F.nullif(F.regexp_extract(hit, tx.UNICODE_I + rules.PRICE_MONEY, k), F.lit(""))

    def step(found: Column, place: Column, hit: Column) -> Column:
        start = F.greatest(F.lit(0), place["start"] - PRICE_WINDOW)
        window = F.substring(text, start + 1, place["end"] + PRICE_WINDOW - start)
        amount = F.replace(F.coalesce(part(hit, 2), part(hit, 3)), F.lit(",")).try_cast("double")
        currency = F.coalesce(tx.lookup(part(hit, 1), rules.CURRENCY_BY_SYMBOL), F.upper(part(hit, 4)))
        priced = let(amount, lambda amount: F.when(amount.isNotNull() & tx.matches(window, rules.PRICING_CONTEXT), F.struct(
            F.least(found["min"], amount).alias("min"), F.greatest(found["max"], amount).alias("max"),
            F.coalesce(found["currency"], currency).alias("currency"), F.coalesce(found["place"], place).alias("place"))))
        return F.coalesce(priced, found)

    def paid(found: Column) -> Column:
        return F.when(found["min"].isNotNull(), F.struct(
            F.lit("PAID_CONSIDERATION").alias("model"), found["min"].alias("min"), found["max"].alias("max"),
            found["currency"].alias("currency"), around(text, found["place"]).alias("excerpt")))
    zero = F.struct(F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
                    F.lit(None).cast("string").alias("currency"), F.lit(None).cast(PLACE).alias("place"))
    free = around(text, first_place(text, rules.PRICE_FREE_PATTERN))
    return F.coalesce(
        F.when(tx.matches(text, rules.PRICE_MONEY), fold_matches(text, rules.PRICE_MONEY, zero, step, paid)),
        let(free, lambda excerpt: F.when(excerpt.isNotNull(), F.struct(
            F.lit("FREE_SUBMISSION").alias("model"), F.lit(0.0).alias("min"), F.lit(0.0).alias("max"),
            F.lit(None).cast("string").alias("currency"), excerpt.alias("excerpt")))))
