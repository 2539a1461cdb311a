"""Text rules as Column expressions."""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp
from collections.abc import Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold import rules

UNICODE_I = "(?iU)"


def col_of(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@lru_cache(maxsize=None)
def needed_words(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which one must occur wherever the pattern does.

    Read off the pattern itself: the longest literal run that no part of it can
    skip, or one run per alternative.  Empty when nothing is certain.
    """
    def best(seq) -> frozenset[str] | None:
        found, run = [], ""
        for op, arg in [*seq, (None, None)]:
            if op is rc.LITERAL:
                run += chr(arg).lower()
                continue
            if run:
                found.append(frozenset([run]))
                run = ""
            if op is rc.SUBPATTERN:
                found.append(best(arg[3]))
            elif op is rc.BRANCH:
                parts = [best(p) for p in arg[1]]
                found.append(frozenset().union(*parts) if all(parts) else None)
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
                found.append(best(arg[2]))
        known = [f for f in found if f]
        return max(known, key=lambda f: (min(map(rare, f)), -len(f)), default=None)

    def rare(word: str) -> int:
        return len(word) + (1 if not word.isalnum() else 0)
    words = best(rp.parse(pattern)) or frozenset()
    return tuple(sorted(words)) if words and min(map(rare, words)) >= 2 else ()


def fold(text) -> Column:
    """Text in the case the needed words are tested in (two letters that case-blind
    matching treats as plain ``s`` and ``i`` are mapped first)."""
    return F.lower(F.replace(F.replace(col_of(text), F.lit("ſ"), F.lit("s")), F.lit("İ"), F.lit("i")))


def matches(text, pattern: str, ignore_case: bool = True, folded: Column | None = None) -> Column:
    """Does the pattern occur?  Unknown text reads as no match.

    With the ``folded`` text at hand, the expression runs only where a word it needs
    occurs at all, which a byte search decides far faster.
    """
    hit = F.coalesce(col_of(text).rlike((UNICODE_I if ignore_case else "(?U)") + pattern), F.lit(False))
    possible = may_match(folded, pattern)
    return hit if possible is None else possible & hit


def may_match(folded: Column | None, pattern: str) -> Column | None:
    """Does a word the pattern needs occur in the folded text?  None where that cannot be told."""
    words = needed_words(pattern) if folded is not None else ()
    if not words:
        return None
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(folded, F.lit(w)) for w in words]), F.lit(False))


def all_matches(text, pattern: str, group: int, folded: Column | None = None) -> Column:
    """A group of every match, with the ``folded`` text looked for only where a word the pattern needs occurs."""
    found = F.regexp_extract_all(col_of(text), F.lit(UNICODE_I + pattern), F.lit(group))
    possible = may_match(folded, pattern)
    return found if possible is None else F.when(possible, found).otherwise(F.array().cast("array<string>"))


def matches_any(text, patterns: Sequence[str], folded: Column | None = None) -> Column:
    if folded is None:
        return matches(text, "(?:" + ")|(?:".join(patterns) + ")")
    return reduce(lambda a, b: a | b, [matches(text, p, folded=folded) for p in patterns])


def collapse_space(text) -> Column:
    """All runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col_of(text), r"(?U)\s+", " "))


def collapse_lines(text) -> Column:
    """Keep paragraph breaks: blanks fold to one, blank lines to one."""
    blanks = F.regexp_replace(col_of(text), r"[ \t\r\f\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(blanks, r"\n\s*\n\s*", "\n\n"),
                            r"(?U)^\s+|\s+$", "")


def bounded_excerpt(text, limit: int = 400) -> Column:
    """At most ``limit`` characters, closed by an ellipsis; null when empty."""
    flat = collapse_space(text)
    return (F.when(F.length(flat) == 0, F.lit(None).cast("string"))
            .when(F.length(flat) <= limit, flat)
            .otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("…"))))


def excerpt_around(text, pattern: str | Column, width: int) -> Column:
    """The first match with ``width // 2`` characters of context on each side.

    The offset is the length of everything before the match, so it counts code
    points like ``substring`` does.  A pattern column is one already known to
    match, or null; so one expression serves a whole rule list.
    """
    text = col_of(text)
    fixed = isinstance(pattern, str)
    core = F.lit(pattern) if fixed else pattern
    hit = matches(text, pattern) if fixed else pattern.isNotNull()

    def place(core: Column) -> Column:
        found = F.call_function("regexp_extract", text, F.concat(F.lit(UNICODE_I), core), F.lit(0))
        before = F.call_function("regexp_extract", text, F.concat(
            F.lit(f"(?s)^(.*?){UNICODE_I}(?:"), core, F.lit(")")), F.lit(1))
        return let(F.length(before), lambda start: F.struct(start.alias("start"), (start + F.length(found)).alias("end")))

    def cut(place: Column) -> Column:
        start = F.greatest(F.lit(0), place["start"] - width // 2)
        end = F.least(F.length(text), place["end"] + width // 2)
        return F.concat(
            F.when(start > 0, F.lit("…")).otherwise(F.lit("")), collapse_space(F.substring(text, start + 1, end - start)),
            F.when(end < F.length(text), F.lit("…")).otherwise(F.lit("")))
    if fixed:
        return F.when(hit, let(place(core), cut))
    return let(core, lambda core: F.when(core.isNotNull(), let(place(core), cut)))


def literal_excerpt(text, needle, width: int = 200) -> Column:
    """The first case-insensitive occurrence of a column value, with context.

    Case folding by ``lower`` can change the length of a few letters; where it
    does, the cut is made on the folded text so the needle is always inside.
    """
    text, needle = col_of(text), F.lower(col_of(needle))
    return cut_around(text, F.lower(text), needle, F.instr(F.lower(text), needle), width)


def cut_around(text: Column, folded: Column, needle: Column, at: Column, width: int) -> Column:
    """The needle found at a place (from 1) of the folded text, with context."""
    base = F.when(F.length(folded) == F.length(text), text).otherwise(folded)
    start = F.greatest(F.lit(0), at - 1 - width // 2)
    end = F.least(F.length(base), at - 1 + F.length(needle) + width // 2)
    return F.when((at > 0) & (F.length(needle) > 0), F.concat(
        F.when(start > 0, F.lit("…")).otherwise(F.lit("")),
        collapse_space(F.substring(base, start + 1, end - start)),
        F.when(end < F.length(base), F.lit("…")).otherwise(F.lit(""))))


def first_label(title, body, rule_list, default: str | None = "UNKNOWN", folded: Column | None = None) -> Column:
    """First rule that holds; the whole list is tried on the title first."""
    chain = None
    for source, low in ([(title, None), (body, folded)] if title is not None else [(body, folded)]):
        for label, pattern in rule_list:
            hit = matches(source, pattern, folded=low)
            chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain.otherwise(F.lit(default).cast("string"))


def all_labels(text, rule_list, folded: Column | None = None) -> Column:
    """Every rule label that holds, in rule order."""
    return F.array_compact(F.array(*[
        F.when(matches(text, pattern, folded=folded), F.lit(label)) for label, pattern in rule_list]))


def label_set(text, labelled, folded: Column | None = None) -> Column:
    """Sorted distinct labels; ``labelled`` = (pattern, label, ignore case)."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[
        F.when(matches(text, pattern, ignore, folded), F.lit(label))
        for pattern, label, ignore in labelled]))))


def secret_labels(text, folded: Column | None = None) -> Column:
    return label_set(text, rules.SECRET_RULES, folded)


def injection_labels(*texts, folded: Sequence[Column] | None = None) -> Column:
    """Labels of agent-directed phrases over hidden text, visible text and URL."""
    labelled = [(p, label, True) for p, label in rules.INJECTION_RULES]
    lows = folded or [None] * len(texts)
    return F.array_sort(F.array_distinct(F.concat(*[label_set(t, labelled, low) for t, low in zip(texts, lows)])))


def looks_like_opt_out(text, folded: Column | None = None) -> Column:
    return matches(text, rules.OPT_OUT, folded=folded)


def slug(title) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(col_of(title))), r"(?U)[^\p{Alnum}]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit("untitled")).otherwise(trimmed)


def name_key(name) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col_of(name), F.lit(""))), r"(?U)[^\p{Alnum}]", "")


def normalize_email(value) -> Column:
    """Lower case, trimmed, plus-tag removed from the mailbox part."""
    v = F.lower(F.trim(col_of(value)))
    local = F.substring_index(v, "@", 1)
    rest = F.substring(v, F.length(local) + 2, F.length(v))
    return F.when(F.instr(v, "@") == 0, v).otherwise(
        F.concat(F.substring_index(local, "+", 1), F.lit("@"), rest))


def preview_email(value) -> Column:
    v = normalize_email(value)
    local = F.substring_index(v, "@", 1)
    rest = F.substring(v, F.length(local) + 2, F.length(v))
    head = F.when(F.length(local) > 2, F.substring(local, 1, 2)).otherwise(F.substring(local, 1, 1))
    return F.when(F.instr(v, "@") == 0, F.lit("•••")).otherwise(
        F.concat(head, F.lit("•••@"), rest))


def email_local(value) -> Column:
    return F.substring_index(F.lower(F.trim(col_of(value))), "@", 1)


def email_domain(value) -> Column:
    v = F.lower(F.trim(col_of(value)))
    return F.when(F.instr(v, "@") > 0, F.substring(v, F.instr(v, "@") + 1, F.length(v)))


def is_freemail(domain) -> Column:
    return F.lower(F.substring_index(F.coalesce(col_of(domain), F.lit("")), ".", 1)).isin(
        rules.FREEMAIL_LABELS)


def is_role_mailbox(local) -> Column:
    return col_of(local).isin(rules.ROLE_LOCAL_PARTS)


def looks_personal(local) -> Column:
    return F.coalesce(col_of(local).rlike(rules.PERSONAL_LOCAL_PART), F.lit(False))


def search_terms(text) -> Column:
    """Lower-case terms without stop words; repeats are kept."""
    found = F.regexp_extract_all(F.lower(col_of(text)), F.lit("[a-z0-9&']+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(rules.SEARCH_STOP_WORDS))


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(col_of(text)), F.lit("[a-z0-9&']+"), F.lit(0))


def fill_template(template, **values) -> Column:
    """Replace ``{name}`` holes; a hole left over makes the result null."""
    out = col_of(template)
    for name, value in values.items():
        out = F.when(value.isNotNull(), F.replace(out, F.lit("{%s}" % name), value)).otherwise(out)
    flat = collapse_space(out)
    return F.when((F.length(flat) > 0) & ~F.contains(flat, F.lit("{")), flat)


def genres_in(text, folded: Column | None = None) -> Column:
    """Vocabulary genres in a text: specific ones first, then broad ones that are
    not already a word of a specific one."""
    low = fold(text) if folded is None else folded
    found = F.array_compact(F.array(*[
        F.when(matches(low, r"\b" + re.escape(g) + r"\b", False, low), F.lit(g)) for g in rules.GENRES]))

    def ordered(f: Column) -> Column:
        specific = F.filter(f, lambda g: g.contains(" ") | g.contains("-"))
        broad = F.filter(f, lambda g: ~g.contains(" ") & ~g.contains("-")
                         & ~F.exists(specific, lambda s: F.array_contains(F.split(s, " "), g)))
        return F.concat(specific, broad)
    return F.transform(F.array(found), ordered)[0]


def allocation_category(service_type) -> Column:
    value = col_of(service_type)
    known = sorted(set(rules.SERVICE_TYPE_TO_ALLOCATION.values()) | {"OTHER"})
    return (F.when(value.isin(known), value)
            .otherwise(F.coalesce(lookup(value, rules.SERVICE_TYPE_TO_ALLOCATION), F.lit("OTHER"))))


def channel_of(service_type) -> Column:
    value = col_of(service_type)
    return F.coalesce(lookup(value, rules.SERVICE_TYPE_TO_CHANNEL), value)


def lookup(key, table: dict) -> Column:
    """A constant map as an expression; null when the key is absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col_of(key))


def default_sentiment(kind) -> Column:
    return F.coalesce(lookup(kind, rules.SENTIMENT), F.lit("NEUTRAL"))


def comma_list(raw) -> Column:
    """Comma text to a list of trimmed, non-empty parts."""
    parts = F.transform(F.split(F.coalesce(col_of(raw), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda p: F.length(p) > 0)


def clean_text(raw) -> Column:
    value = F.trim(col_of(raw))
    return F.when(F.length(value) > 0, value)


def separated_integer(raw) -> Column:
    """Integer text with thousands separators; null when it is not one."""
    return F.regexp_replace(col_of(raw), "[, ]", "").try_cast("bigint")


def integer_list(raw) -> Column:
    return F.array_compact(F.transform(comma_list(raw), lambda p: p.try_cast("bigint")))


def tri_state(raw) -> Column:
    value = F.lower(F.trim(col_of(raw)))
    return (F.when(value.isNull() | value.isin("", "unknown"), F.lit(None).cast("boolean"))
            .otherwise(value.isin("1", "true", "yes", "on")))


def json_list(raw) -> Column:
    """JSON text holding a list of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(col_of(raw), "array<string>"), F.array().cast("array<string>"))
