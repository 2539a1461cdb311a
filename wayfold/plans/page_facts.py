"""One structured record per page, from the sanitised columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import passages
from wayfold.functions import text as tx
from wayfold.functions import web
from wayfold.functions.when import plus_days
from wayfold.operators.upsert import upsert_buckets
from wayfold.sources.pages import read_pages


def joined_text(*parts: str) -> Column:
    """Non-empty parts separated by a blank."""
    return F.concat_ws(" ", *[F.when(F.length(F.col(p)) > 0, F.col(p)) for p in parts])


def page_state(status: Column, title: Column, text: Column) -> Column:
    """Real content, or an interstitial or error page standing in front of it."""
    whole = F.concat_ws(" ", F.when(F.length(title) > 0, title), F.when(F.length(text) > 0, text))
    return (F.when(F.coalesce(status >= 400, F.lit(False)), "ERROR")
            .when(passages.let(whole, lambda whole: passages.let(
                tx.fold(whole), lambda low: tx.matches_any(whole, rules.CHALLENGE_PATTERNS, low))), "BOT_CHALLENGE")
            .when(tx.matches(title, rules.ERROR_TITLE_PATTERN), "ERROR").otherwise("OK"))


def class_matches(whole: Column, title: Column, folded: Column | None = None) -> Column:
    """Every class rule that holds, with its weight and the title bonus."""
    return F.array_compact(F.array(*[
        F.when(tx.matches(whole, pattern, folded=folded), F.struct(
            (F.lit(weight) + F.when(tx.matches(title, pattern), rules.TITLE_BONUS).otherwise(0)).alias("weight"),
            F.lit(-place).alias("place"), F.lit(label).alias("label")))
        for place, (label, weight, pattern) in enumerate(rules.PAGE_CLASS_RULES)]))


def first_hit(text: Column, patterns, folded: Column | None = None) -> Column:
    """The first pattern that matches, as a column; null when none does."""
    chain = None
    for pattern in patterns:
        hit = tx.matches(text, pattern, folded=folded)
        chain = F.when(hit, F.lit(pattern)) if chain is None else chain.when(hit, F.lit(pattern))
    return chain


def submission_hit(text: Column, folded: Column | None = None) -> Column:
    """The first pattern about submissions that matches, those that close them first."""
    return first_hit(text, [*rules.CLOSED_PATTERNS, *rules.OPEN_PATTERNS], folded)


def submissions(text: Column, folded: Column | None = None, hit: Column | None = None) -> Column:
    """Open or closed, by the rules' ``submission_hit`` where it is at hand."""
    hit = submission_hit(text, folded) if hit is None else hit
    closed = F.coalesce(hit.isin(rules.CLOSED_PATTERNS), F.lit(False))
    return F.struct(
        F.when(closed, "CLOSED").when(hit.isNotNull(), "OPEN").otherwise("UNKNOWN").alias("state"),
        F.when(closed, 0.85).when(hit.isNotNull(), 0.8).otherwise(0.0).alias("confidence"),
        tx.excerpt_around(text, hit, 160).alias("excerpt"))


def cost_signs(text: Column, folded: Column | None = None) -> tuple[Column, Column, Column]:
    """Does the text speak of free submissions, of a fee, of advertising?"""
    return tuple(tx.matches(text, p, folded=folded) for p in (rules.FREE_SUBMISSION_PATTERN, rules.FEE_PATTERN, rules.AD_OFFER_PATTERN))


def cost(text: Column, label: Column, folded: Column | None = None, signs: tuple[Column, Column, Column] | None = None) -> Column:
    """Cost model ladder: guarantees, free, fee, advertising, unknown; by the ``cost_signs`` where they are at hand."""
    free, fee, ad = signs or cost_signs(text, folded)
    passage = F.regexp_extract(text, tx.UNICODE_I + rules.FEE_PATTERN, 0)
    money = [F.regexp_extract(passage, tx.UNICODE_I + rules.PAGE_MONEY, g) for g in range(5)]
    raw = F.when(money[2] != "", money[2]).otherwise(money[3])
    priced = fee & ~free & (money[0] != "")
    guaranteed = label.isin("GUARANTEED_STREAMS", "GUARANTEED_PLACEMENT")
    return F.struct(
        F.when(guaranteed, label).when(free, "FREE_SUBMISSION").when(fee, "PAID_CONSIDERATION")
        .when(ad, "ADVERTISING_OR_SPONSORSHIP").otherwise("UNKNOWN").alias("model"),
        F.when(guaranteed, F.lit(None)).when(free, F.lit(0.0))
        .when(priced, F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")).alias("amount"),
        F.when(~guaranteed & priced, F.coalesce(tx.lookup(money[1], rules.CURRENCY_BY_SYMBOL),
                                                F.upper(F.nullif(money[4], F.lit(""))))).alias("currency"),
        tx.excerpt_around(text, F.when(guaranteed, F.lit(None).cast("string")).when(free, F.lit(rules.FREE_SUBMISSION_PATTERN))
                          .when(fee, F.lit(rules.FEE_PATTERN)).when(ad, F.lit(rules.AD_OFFER_PATTERN)), 160).alias("excerpt"),
        F.when(guaranteed, 0.9).when(free | fee, 0.8).when(ad, 0.6).otherwise(0.0).alias("confidence"))


def outlet_name(title: Column, domain: Column) -> Column:
    """The site half of a "Page — Site" title, else the title, else the domain."""
    chosen = None
    for sep in rules.TITLE_SEPARATORS:
        parts = F.filter(F.transform(F.split(title, r"\Q" + sep + r"\E"), lambda x: F.trim(x)), lambda p: F.length(p) > 0)
        hit = F.contains(title, F.lit(sep)) & (F.size(parts) >= 2)
        last = F.try_element_at(parts, F.lit(-1))
        chosen = F.when(hit, last) if chosen is None else chosen.when(hit, last)
    name = F.trim(chosen.otherwise(title))
    return F.when(F.length(name).between(2, 80), name).otherwise(domain)


def contact_candidates(emails: Column) -> Column:
    """Addresses with their role flag: role mailboxes, then mailto links, then by value."""
    described = F.transform(emails, lambda e: F.struct(
        (~F.lower(F.substring_index(F.trim(e["value"]), "@", 1)).isin(rules.ROLE_LOCAL_PARTS)).alias("not_role"),
        (e["origin"] != "mailto-link").alias("not_mailto"), F.trim(e["value"]).alias("value"),
        e["text"].alias("link_text")))
    return F.transform(F.array_sort(described), lambda e: F.struct(
        e["value"].alias("value"),
        F.when(e["not_mailto"], "visible-text").otherwise("mailto-link").alias("origin"),
        (~e["not_role"]).alias("role_based"), e["link_text"].alias("link_text")))


def submission_links(links: Column) -> Column:
    def wanted(link: Column) -> Column:
        href = F.lower(F.coalesce(link["href"], F.lit("")))
        hay = F.concat_ws(" ", href, F.lower(F.coalesce(link["text"], F.lit(""))))
        skip = href.rlike("^(" + "|".join(rules.NON_PAGE_SCHEMES) + ")")
        return ~skip & hay.rlike("|".join(rules.SUBMISSION_LINK_WORDS))
    return F.transform(F.filter(links, wanted), lambda k: F.struct(k["href"].alias("href"), k["text"].alias("text")))


def latest_date(text: Column, folded: Column | None = None) -> Column:
    """The latest date in the text, null without one."""
    return F.array_max(F.concat(*[tx.all_matches(text, p, 1, folded) for p in (rules.ISO_DATE_PATTERN, rules.MONTH_DATE_PATTERN)]))


def freshness(hint: Column, text: Column, latest: Column | None = None) -> Column:
    """What the page says about its own date: markup first, else the ``latest_date`` in the text."""
    latest = latest_date(text) if latest is None else latest
    marked = F.length(hint) > 0
    return F.struct(
        F.when(marked, F.substring(hint, 1, 10)).otherwise(latest).alias("date"),
        F.when(marked, "markup").when(latest.isNotNull(), "page-text").alias("source"),
        F.when(marked, 0.8).when(latest.isNotNull(), 0.4).otherwise(0.0).alias("confidence"))


def with_declared_links(records: DataFrame, links: str = "links", domain: str = "domain") -> DataFrame:
    """Adds ``declared``, the first same-domain link per kind: terms, privacy, pricing, submission, contact.

    The links of the own domain are picked once, and each kind is a column of its own, so that it is looked for once and only where it is read.
    """
    def own(link: Column) -> Column:
        return (F.lower(link["href"]).rlike("^https?://")
                & (web.registrable_domain(web.host_of(link["href"])) == F.col(domain)))
    mine = F.filter(F.coalesce(F.col(links), F.array().cast("array<struct<href:string,raw_href:string,text:string>>")), own)

    def reads_like(pattern: str):
        return lambda link: tx.matches(F.concat_ws(" ", link["href"], F.coalesce(link["text"], F.lit(""))), pattern)
    kinds = {f"__{name}": F.try_element_at(F.filter("__own", reads_like(pattern)), F.lit(1))["href"] for name, pattern in rules.DECLARED_LINKS}
    return (records.withColumn("__own", mine).withColumns(kinds)
            .withColumn("declared", F.struct(*[F.col(f"__{name}").alias(name) for name, _ in rules.DECLARED_LINKS])).drop("__own", *kinds))


def extract(sanitised: DataFrame, url: str = "url", status: str = "http_status", offers: bool = False) -> DataFrame:
    """The page record.  Expects the columns of :func:`read_pages`; ``offers`` adds block signals, stated facts and prices."""
    code = F.col(status) if status in sanitised.columns else F.lit(None).cast("int")
    title = F.coalesce(F.col("title"), F.lit(""))
    text = F.col("visible_text")
    base = (sanitised
            .withColumn("domain", web.registrable_domain(web.host_of(url)))
            .withColumn("whole_text", joined_text("title", "meta_description", "visible_text"))
            .withColumns({"folded_whole": tx.fold("whole_text"), "folded_text": tx.fold("visible_text"), "folded_hidden": tx.fold("hidden_text"),
                          "folded_url": tx.fold(url),
                          "page_state": page_state(code, title, text)})
            .withColumn("matches", class_matches(F.col("whole_text"), title, F.col("folded_whole"))))
    best = F.array_max("matches")
    judged = (base.withColumn("__best", best)
              .withColumn("classification", F.struct(
                  F.coalesce(F.col("__best.label"), F.lit("UNKNOWN")).alias("label"),
                  F.when(F.col("__best").isNull(), 0.0).otherwise(F.least(F.lit(0.95), F.col("__best.weight") / 100.0)).alias("confidence"),
                  tx.excerpt_around(F.col("whole_text"), F.element_at(
                      F.array(*[F.lit(p) for _l, _w, p in rules.PAGE_CLASS_RULES]), 1 - F.col("__best.place")), 160).alias("excerpt")))
              .drop("__best"))
    low = F.col("folded_text")
    if offers:
        whole = F.col("folded_whole")
        judged = judged.withColumn("__body", joined_text("meta_description", "visible_text")).withColumns({
            "signals": passages.block_signals(F.col("whole_text"), whole),
            "facts": passages.stated_facts(title, F.col("__body"), whole),
            "prices": passages.stated_prices(text)}).drop("__body")
    # what several fields of a record build on is a column of its own, worked out once
    signs = dict(zip(("__free", "__fee", "__ad"), cost_signs(text, low)))
    judged = judged.withColumns({"__hit": submission_hit(text, low), **signs, "__dated": latest_date(text, low)})
    return judged.withColumns({
        "submissions": submissions(text, hit=F.col("__hit")),
        "cost": cost(text, F.col("classification.label"), signs=tuple(F.col(c) for c in signs)),
        "genres": tx.genres_in("whole_text", F.col("folded_whole")),
        "contacts": contact_candidates(F.col("emails")),
        "submission_links": submission_links(F.col("links")),
        "requires_login": tx.matches_any(text, rules.LOGIN_PATTERNS, low),
        "requires_captcha": tx.matches(
            F.concat_ws(" ", text, F.array_join(F.transform("links", lambda k: k["href"]), " ")), rules.CAPTCHA_PATTERN),
        "freshness": freshness(F.col("last_modified_hint"), text, F.col("__dated")),
        "outlet_name": outlet_name(title, F.col("domain")),
        "injection_findings": tx.injection_labels("hidden_text", "visible_text", url, folded=[
            F.col("folded_hidden"), low, F.col("folded_url")])}).drop(
                "folded_whole", "folded_text", "folded_hidden", "folded_url", "__hit", "__dated", *signs)


def is_offer_page(whole: Column) -> Column:
    """A first-party offer, not an article about the industry."""
    return ~tx.matches_any(whole, rules.ARTICLE_SHAPE) & tx.matches_any(whole, rules.OFFER_SIGNALS)


def price_login_wall(whole: Column, text: Column, requires_login: Column, url: Column, pricing_url: Column) -> Column:
    """Passage that shows a login wall in front of a price, null otherwise.

    On the pricing page itself the wall is the answer, whatever its words; elsewhere a word about prices must stand there.
    """
    there = F.coalesce((F.length(pricing_url) > 0) & (url == pricing_url), F.lit(False))
    return F.when(requires_login, F.when(there, passages.around(text, passages.first_place(text, "[^\\n]")))
                  .otherwise(passages.around(whole, passages.first_place(whole, rules.LOGIN_PRICING_CONTEXT))))


def page_records(pages: DataFrame, offers: bool = False) -> DataFrame:
    """Crawl table to page records in one pass over the pages."""
    return extract(read_pages(pages), offers=offers)


def source_documents(records: DataFrame, refused: DataFrame, as_of,
                     provider: str = "open_web_fetch") -> DataFrame:
    """One row per retrieval attempt, refusals included, with a bounded excerpt.

    ``campaign_id`` and ``attempted_at`` go along where the records have them.
    """
    from wayfold.functions.keys import content_hash, url_hash
    more = [c for c in ("campaign_id", "attempted_at") if c in records.columns]
    refused = refused.withColumns({c: F.lit(None).cast(dict(records.dtypes)[c]) for c in more if c not in refused.columns})
    shape = [*more, "tenant_id", "url", "url_hash", "domain", "provider", "fetch_status", "content_hash",
             "sanitized_text", "title", "classification", "block_reason", "stale_at"]
    ok = (records.withColumn("fetch_status", F.lit("OK")).withColumn("block_reason", F.lit(None).cast("string"))
          .withColumn("content_hash", F.when(F.length("visible_text") > 0, content_hash("visible_text")))
          .withColumn("sanitized_text", tx.bounded_excerpt("visible_text", 2000))
          .withColumn("classification", F.col("classification.label")))
    no = (refused.withColumn("fetch_status", F.lit("BLOCKED"))
          .withColumn("domain", web.registrable_domain(web.host_of("url"))))
    for c in ("content_hash", "sanitized_text", "title", "classification"):
        no = no.withColumn(c, F.lit(None).cast("string"))

    def close(df: DataFrame) -> DataFrame:
        return (df.withColumn("url_hash", url_hash("url")).withColumn("provider", F.lit(provider))
                .withColumn("stale_at", plus_days(as_of, rules.EVIDENCE_STALE_DAYS)).select(*shape))
    return close(ok).unionByName(close(no))


DOCUMENT_KEY = ["tenant_id", "url_hash", "campaign_id"]


def keep_documents(path: str, documents: DataFrame) -> None:
    """Store retrieval attempts, one row per tenant, URL and campaign: a page that is read again replaces its row."""
    upsert_buckets(documents.sparkSession, path, documents, DOCUMENT_KEY, ["attempted_at", "content_hash"])


def evidence_packets(records: DataFrame, entity: str, entity_type: str, as_of,
                     extra_keys=("tenant_id",)) -> DataFrame:
    """One row per supported field of a record, each with excerpt and confidence."""
    label, sub = F.col("classification"), F.col("submissions")
    packets = F.array_compact(F.array(
        F.struct(F.lit("classification").alias("supports_field"), label["label"].alias("value"),
                 label["excerpt"].alias("excerpt"), label["confidence"].alias("confidence")),
        F.when(sub["state"] != "UNKNOWN", F.struct(
            F.lit("submissions_open").alias("supports_field"), sub["state"].alias("value"),
            sub["excerpt"].alias("excerpt"), sub["confidence"].alias("confidence")))))
    return (records.select(*extra_keys, F.col(entity).alias("entity_id"), F.col("url").alias("source_url"),
                           F.col("domain").alias("source_domain"), F.explode(packets).alias("p"))
            .select(*extra_keys, F.lit(entity_type).alias("entity_type"), "entity_id", "source_url",
                    "source_domain", F.lit("OFFICIAL").alias("source_type"), "p.*")
            .withColumn("excerpt", tx.bounded_excerpt("excerpt"))
            .withColumn("stale_at", plus_days(as_of, rules.EVIDENCE_STALE_DAYS)))


def provenance(evidence: DataFrame, as_of) -> DataFrame:
    """Every claim with its freshness and the number of domains that back its field."""
    from wayfold.functions.when import is_stale
    keys = ["entity_type", "entity_id", "supports_field"]
    backing = corroboration(evidence)
    return (evidence.join(backing, keys, "left")
            .withColumn("stale", is_stale("stale_at", as_of))
            .withColumn("official", F.coalesce(F.col("source_type") == "OFFICIAL", F.lit(False))))


def corroboration(evidence: DataFrame) -> DataFrame:
    """Distinct source domains per supported field; unknown domains do not count."""
    return evidence.groupBy("entity_type", "entity_id", "supports_field").agg(
        F.countDistinct(F.when(F.length("source_domain") > 0, F.col("source_domain"))).alias("corroborating_domains"))
