"""Scores in which unknown is never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions.text import col_of


def _norm(items) -> Column:
    trimmed = F.transform(F.coalesce(col_of(items), F.array().cast("array<string>")),
                          lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (F.length(x) > 0)))


def overlap(left, right) -> Column:
    """Share of the left set met by the right one.

    Null when either side is empty; a direct hit counts against at most three
    items; a substring relation alone is worth one half.
    """
    l, r = _norm(left), _norm(right)
    hits = F.size(F.array_intersect(l, r))
    partial = F.exists(l, lambda a: F.exists(r, lambda b: F.contains(b, a) | F.contains(a, b)))
    return (F.when((F.size(l) == 0) | (F.size(r) == 0), F.lit(None).cast("double"))
            .when(hits > 0, F.least(F.lit(1.0), hits / F.least(F.size(l), F.lit(3))))
            .when(partial, F.lit(0.5)).otherwise(F.lit(0.0)))


def known_weight(parts) -> Column:
    """Weight of the components that are known; ``parts`` = [(column, weight)]."""
    total = F.lit(0.0)
    for value, weight in parts:
        total = total + F.when(col_of(value).isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))
    return total


def weighted_score(parts, empty: int | None = None) -> Column:
    """0-100 mean over known components only, half to even."""
    num = F.lit(0.0)
    for value, weight in parts:
        num = num + F.coalesce(col_of(value) * F.lit(weight), F.lit(0.0))
    den = known_weight(parts)
    return F.when(den > 0, F.bround(num / den * 100)).otherwise(F.lit(empty)).cast("bigint")


def covered_score(parts, hollow=(), minimum: float = rules.MIN_SCORE_COVERAGE) -> Column:
    """Weighted score, withheld while less than ``minimum`` of the weight is known
    or while only ``hollow`` components (index positions) are."""
    solid = [v for i, (v, _) in enumerate(parts) if i not in set(hollow)]
    any_solid = F.coalesce(*[F.when(col_of(v).isNotNull(), F.lit(True)) for v in solid],
                           F.lit(False))
    return F.when(any_solid & (known_weight(parts) >= minimum), weighted_score(parts))


def tri_value(flag) -> Column:
    return col_of(flag).cast("double")


def severity(label, table: dict) -> Column:
    """Severity number of a label, for folding by ``max``."""
    chain = None
    for name, number in table.items():
        hit = col_of(label) == name
        chain = F.when(hit, F.lit(number)) if chain is None else chain.when(hit, F.lit(number))
    return chain


def by_severity(number, table: dict) -> Column:
    chain = None
    for name, value in table.items():
        hit = col_of(number) == value
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain


def risk_score(signals) -> Column:
    """Sum of distinct signal weights, capped at 100."""
    weights = F.create_map(*[F.lit(x) for s, w, _ in rules.RISK_SIGNALS for x in (s, w)])
    return F.least(F.lit(100), F.aggregate(
        F.array_distinct(col_of(signals)), F.lit(0),
        lambda acc, s: acc + F.coalesce(F.try_element_at(weights, s), F.lit(0)))).cast("bigint")


def risk_band(score) -> Column:
    chain = None
    for band, lowest in rules.RISK_BANDS:
        hit = col_of(score) >= lowest
        chain = F.when(hit, F.lit(band)) if chain is None else chain.when(hit, F.lit(band))
    return chain


def percent(part, whole, empty=None) -> Column:
    """Rounded percentage with an explicit value for an empty base."""
    p, w = col_of(part), col_of(whole)
    return F.when(w > 0, F.bround(p / w * 100)).otherwise(F.lit(empty)).cast("bigint")


def audience_fit(count, source) -> Column:
    c = col_of(count)
    return (F.when(c.isNull() | (F.coalesce(F.length(col_of(source)), F.lit(0)) == 0),
                   F.lit(None).cast("double"))
            .when(c >= 100_000, F.lit(0.9)).when(c >= 10_000, F.lit(0.8))
            .when(c >= 1_000, F.lit(0.7)).otherwise(F.lit(0.5)))


def credibility(organization, url, description, corroboration) -> Column:
    def present(c) -> Column:
        return F.coalesce(F.length(col_of(c).cast("string")) > 0, F.lit(False))
    points = (F.when(present(organization), F.lit(0.4)).otherwise(F.lit(0.0))
              + F.when(present(url), F.lit(0.2)).otherwise(F.lit(0.0))
              + F.when(present(description), F.lit(0.2)).otherwise(F.lit(0.0))
              + F.when(F.coalesce(col_of(corroboration), F.lit(0)) >= 2, F.lit(0.2)).otherwise(F.lit(0.0)))
    return F.least(F.lit(1.0), points)


def submission_fit(method, open_state, needs_login, needs_captcha) -> Column:
    m, state = col_of(method), col_of(open_state)
    walled = F.coalesce(col_of(needs_login), F.lit(False)) | F.coalesce(col_of(needs_captcha), F.lit(False))
    return (F.when(state == "CLOSED", F.lit(0.0))
            .when(m.isNull(), F.lit(None).cast("double"))
            .when((m == "EMAIL") & (state == "OPEN"), F.lit(1.0))
            .when(walled, F.lit(0.4)).otherwise(F.lit(0.7)))


def contact_fit(has_contact, sendable, category) -> Column:
    return (F.when(~F.coalesce(col_of(has_contact), F.lit(False)), F.lit(None).cast("double"))
            .when(F.coalesce(col_of(sendable), F.lit(False)), F.lit(1.0))
            .when(col_of(category) == "UNVERIFIED_PUBLIC_BUSINESS", F.lit(0.4))
            .otherwise(F.lit(0.1)))


def relationship_fit(has_relationship, accepted, declined, placed) -> Column:
    def n(c) -> Column:
        return F.coalesce(col_of(c), F.lit(0))
    return (F.when(~F.coalesce(col_of(has_relationship), F.lit(False)), F.lit(None).cast("double"))
            .when(n(placed) > 0, F.lit(1.0)).when(n(accepted) > 0, F.lit(0.85))
            .when(n(declined) > 0, F.lit(0.2)).otherwise(F.lit(0.5)))


def cost_fit(model, amount) -> Column:
    m, a = col_of(model), F.coalesce(col_of(amount), F.lit(0.0))
    return (F.when(m == "FREE_SUBMISSION", F.lit(1.0))
            .when(m.isin("GUARANTEED_PLACEMENT", "GUARANTEED_STREAMS"), F.lit(0.0))
            .when((m == "PAID_CONSIDERATION") & (a > 0) & (a <= 20), F.lit(0.4))
            .when(m == "PAID_CONSIDERATION", F.lit(0.2)))


def territory_fit(territory, wanted) -> Column:
    t, w = col_of(territory), col_of(wanted)
    return F.when((F.length(t) > 0) & (F.size(w) > 0),
                  F.when(F.array_contains(w, t), F.lit(1.0)).otherwise(F.lit(0.2)))


def budget_fit(price, budget) -> Column:
    p, b = col_of(price), col_of(budget)
    return F.when(p.isNotNull() & b.isNotNull(),
                  F.when(p <= b, F.lit(1.0)).otherwise(F.lit(0.0)))


def opportunity_reasons(components: dict, limit: int = 8) -> Column:
    """Reasons by falling weight: '?' unknown, '+' high, '-' low."""
    ordered = sorted(rules.OPPORTUNITY_COMPONENTS, key=lambda row: -row[1])
    items = []
    for name, _w, label, high, low in ordered:
        v = components[name]
        items.append(F.when(v.isNull(), F.struct(F.lit("?").alias("sign"), F.lit(f"{label} unverified").alias("text")))
                     .when(v >= 0.75, F.struct(F.lit("+").alias("sign"), F.lit(high).alias("text")))
                     .when(v <= 0.25, F.struct(F.lit("-").alias("sign"), F.lit(low).alias("text"))))
    return F.slice(F.array_compact(F.array(*items)), 1, limit)


def fit_reasons(components: dict, limit: int = 6) -> Column:
    ordered = sorted(rules.FIT_COMPONENTS, key=lambda row: -row[1])
    items = []
    for name, _w, label in ordered:
        v = components[name]
        items.append(F.when(v.isNull(), F.struct(F.lit("?").alias("sign"), F.lit(f"{label} unverified").alias("text")))
                     .when(v >= 0.75, F.struct(F.lit("+").alias("sign"), F.lit(label).alias("text"))))
    return F.slice(F.array_compact(F.array(*items)), 1, limit)


def infer_country(territory, domain) -> Column:
    from wayfold.functions.text import lookup
    tld = F.lower(F.substring_index(col_of(domain), ".", -1))
    t = col_of(territory)
    return F.coalesce(F.when(F.length(t) > 0, F.upper(t)), lookup(tld, rules.TLD_COUNTRY))


def rule_set(country) -> Column:
    c = F.upper(col_of(country))
    return (F.when(c == "US", "US").when(c == "CA", "CA").when(c == "GB", "UK")
            .when(c.isin(rules.EU_EEA), "EU").otherwise("OTHER"))


def growth_percent(series) -> Column:
    """First to last of a series; null with under two points or a first value <= 0."""
    s = col_of(series)
    first, last = F.try_element_at(s, F.lit(1)), F.try_element_at(s, F.lit(-1))
    return F.when((F.size(s) >= 2) & (first > 0),
                  F.bround((last - first) / first * 100).cast("bigint"))
