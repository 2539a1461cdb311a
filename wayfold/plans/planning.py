"""Search query planning and search results to fetch lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold import rules
from wayfold.functions import text as tx
from wayfold.functions import web
from wayfold.operators.latest import cap_edges, first_n_per_key, ordered_distinct, round_robin
from wayfold.session import spread

PLAN = "array<struct<family:string,query:string,territory:string,language:string>>"


def _row(family: Column | str, query: Column, territory: Column | None = None,
         language: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((family if isinstance(family, Column) else F.lit(family)).alias("family"),
                    query.alias("query"), (territory if territory is not None else none).alias("territory"),
                    (language if language is not None else F.lit("en")).alias("language"))


def _filler(family: str, template: str, territory: Column | None = None):
    """Row builder for one template: the genre fills both genre holes."""
    more = {} if territory is None else {"territory": territory}
    return lambda genre: _row(family, tx.fill_template(F.lit(template), genre=genre, microgenre=genre, **more))


def _each(values: Column, build) -> Column:
    return F.flatten(F.transform(values, lambda v: F.array(*build(v))))


def _usable(query: Column) -> Column:
    return query.isNotNull() & (F.length(query) > 0) & ~F.contains(query, F.lit("{"))


def _interleaved(rows: DataFrame, plan: Column, keys, budget: int) -> DataFrame:
    """First spelling of each query, families in turn, cut at the budget.

    The plan of a key with one row is ordered inside that row, so no query travels; only the ids do, to find the keys
    of several rows, whose queries are then ordered together.
    """
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    several = rows.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1").select(*keys)
    alone = spread(rows.filter(known).join(several, list(keys), "left_anti")).select(*keys, plan.cast(PLAN).alias("plan"))
    shared = rows.filter(known).join(several, list(keys), "left_semi").unionByName(rows.filter(~known))
    return _interleaved_alone(alone, keys, budget).unionByName(
        _interleaved_together(shared.select(*keys, plan.cast(PLAN).alias("plan")), keys, budget))


def _interleaved_alone(planned: DataFrame, keys, budget: int) -> DataFrame:
    """The plans of keys with one row each, without a shuffle."""
    clean = F.filter(F.transform("plan", lambda q, i: F.struct(
        i.alias("place"), q["family"].alias("family"), tx.collapse_space(q["query"]).alias("query"),
        q["territory"].alias("territory"), q["language"].alias("language"))), lambda q: _usable(q["query"]))
    folds = F.transform("clean", lambda q: F.lower(F.trim(q["query"])))
    unique = F.filter("clean", lambda q, i: F.array_position("folds", F.get("folds", i)) == i + 1)
    in_turn = F.flatten(F.transform(F.array_distinct(F.transform("unique", lambda q: q["family"])), lambda f: F.transform(
        F.filter("unique", lambda q: q["family"].eqNullSafe(f)), lambda q, i: F.struct(
            (i + 1).alias("turn"), q["family"].alias("family"), q["place"].alias("place"), q["query"].alias("query"),
            q["territory"].alias("territory"), q["language"].alias("language")))))
    ordered = (planned.select(*keys, clean.alias("clean")).select(*keys, "clean", folds.alias("folds"))
               .select(*keys, unique.alias("unique")).select(*keys, F.slice(F.sort_array(in_turn), 1, budget).alias("head")))
    # outer: of an inner one Spark takes a filter on the size of the head, and works the plan out again inside it, once an element
    return (ordered.select(*keys, F.posexplode_outer("head").alias("__at", "q")).filter(F.col("__at").isNotNull())
            .select(*keys, "q.*", (F.col("__at") + 1).alias("position")))


def _interleaved_together(planned: DataFrame, keys, budget: int) -> DataFrame:
    rows = planned.select(*keys, F.posexplode("plan").alias("place", "q")).select(*keys, "place", "q.*")
    clean = rows.withColumn("query", tx.collapse_space("query")).filter(_usable(F.col("query")))
    unique = ordered_distinct(clean, keys, "query", ["place"])
    return round_robin(unique, keys, "family", ["place"], budget)


def campaign_queries(campaigns: DataFrame, budget: int = rules.DEFAULT_SEARCH_BUDGET) -> DataFrame:
    """Queries per campaign from its channels, territories and profile values.

    ``campaigns`` needs campaign_id, channels, territories, genres (primary first),
    microgenres, comparable_artists, scene and radio_formats.
    """
    genres, micros = F.slice("genres", 1, 2), F.slice("microgenres", 1, 3)
    local = F.when(F.size("microgenres") > 0, F.slice("microgenres", 1, 1)).otherwise(F.slice("genres", 1, 1))

    def table(templates: dict) -> Column:
        return F.create_map(*[x for name, items in templates.items() for x in (F.lit(name), F.array(*[F.lit(i) for i in items]))])

    def filled(key: Column, templates: dict, values: Column, build) -> Column:
        """Templates of one key times the values, templates outside."""
        found = F.coalesce(F.try_element_at(table(templates), key), F.array().cast("array<string>"))
        return F.flatten(F.transform(found, lambda tpl: F.transform(values, lambda v: build(tpl, v))))

    def channel_rows() -> Column:
        return F.flatten(F.transform("channels", lambda c: filled(
            c, rules.CHANNEL_TEMPLATES, F.concat(genres, micros),
            lambda tpl, g: _row(c, tx.fill_template(tpl, genre=g, microgenre=g)))))

    def local_rows() -> Column:
        return F.flatten(F.transform("territories", lambda t: F.concat(
            filled(F.upper(t), rules.LANGUAGE_TEMPLATES, local,
                   lambda tpl, g: _row("LOCAL_LANGUAGE", tx.fill_template(tpl, genre=g), t, F.lower(t))),
            F.transform(local, lambda g: _row("TERRITORY", F.concat_ws(" ", t, g, F.lit("playlist curator")), t)))))

    plan = F.concat(
        channel_rows(),
        _each(F.slice("comparable_artists", 1, 3), lambda a: [
            _row("COMPARABLE", F.concat(F.lit("playlists featuring "), a)),
            _row("COMPARABLE", F.concat(a, F.lit(" similar artists submissions")))]),
        F.when(F.length("scene") > 0, F.array(_row("SCENE", F.concat(F.col("scene"), F.lit(" scene submit music")))))
        .otherwise(F.array().cast(PLAN)),
        F.transform(F.slice("radio_formats", 1, 2), lambda f: _row("RADIO", F.concat(f, F.lit(" radio format submissions")))),
        local_rows())
    return _interleaved(campaigns, plan, ["campaign_id"], budget)


def promotion_queries(tenants: DataFrame, budget: int = rules.PROMOTION_SEARCH_CAP) -> DataFrame:
    """Paid-promotion queries per tenant (genres, microgenres, territories in order)."""
    territory = F.coalesce(F.try_element_at(F.col("territories"), F.lit(1)), F.lit(""))
    values = F.concat(F.slice("genres", 1, 2), F.slice("microgenres", 1, 2))
    parts = []
    for family, templates in rules.PROMOTION_TEMPLATES.items():
        for t in templates:
            parts.append(F.transform(values, _filler(family, t, territory)))
    seeds = F.array(*[_row("SEED", F.lit(f'"{n}" pricing submission terms')) for n in rules.SEED_SERVICES])
    plan = F.concat(*parts, seeds)
    return _interleaved(tenants, plan, ["tenant_id"], budget)


def coverage_queries(watched: DataFrame, cap: int = rules.SWEEP_SEARCH_CAP) -> DataFrame:
    """Three coverage queries per active watched name."""
    rows = watched.filter("active").select("tenant_id", "artist_id", "created_at", "seq", F.posexplode(F.array(*[
        F.replace(F.lit(t), F.lit("{name}"), F.col("name")) for t in rules.ARTIST_QUERY_TEMPLATES])).alias("place", "query"))
    return first_n_per_key(rows, ["tenant_id"], ["created_at", "seq", "place"], cap)


def trend_queries(names: DataFrame, cap: int = rules.TREND_SEARCH_CAP) -> DataFrame:
    """Trend queries per tenant: genres, then microgenres, then watched names, each text
    once.  ``names(tenant_id, source, seq, name)`` with source GENRE, MICRO or ARTIST."""
    def filled(templates) -> Column:
        return F.array(*[F.replace(F.lit(t), F.lit("{name}"), F.col("name")) for t in templates])
    texts = (F.when(F.col("source") == "GENRE", filled(rules.GENRE_TREND_TEMPLATES))
             .when(F.col("source") == "MICRO", filled(rules.MICRO_TREND_TEMPLATES))
             .otherwise(filled(rules.ARTIST_TREND_TEMPLATES)))
    group = F.when(F.col("source") == "GENRE", 0).when(F.col("source") == "MICRO", 1).otherwise(2)
    rows = names.select("tenant_id", "name", "source", "seq", group.alias("group"), F.posexplode(texts).alias("place", "query"))
    once = ordered_distinct(rows, ["tenant_id"], "query", ["group", "seq", "place"])
    return first_n_per_key(once, ["tenant_id"], ["group", "seq", "place"], cap)


def fetch_list(results: DataFrame, domain_budget: int = rules.DEFAULT_DOMAIN_BUDGET) -> DataFrame:
    """Search results to pages worth fetching.

    ``results(campaign_id, seq, url)``: admission rules, platform domains, the first
    sight of each URL and the per-domain budget.  Refused rows stay, with a reason.
    """
    judged = (results.withColumn("reason", web.block_reason("url"))
              .withColumn("domain", web.registrable_domain(web.host_of("url"))))
    judged = judged.withColumn("reason", F.coalesce("reason", F.when(web.is_platform("domain"), F.lit("PLATFORM_DOMAIN"))))
    edges = cap_edges(judged.filter(F.col("reason").isNull()), ["campaign_id", "domain"], ["seq"], domain_budget, "__edge")
    over = F.when(F.struct("seq") > F.col("__edge"), F.lit("DOMAIN_BUDGET"))
    return judged.join(edges, ["campaign_id", "domain"], "left").withColumn("reason", F.coalesce("reason", over)).drop("__edge")


def watch_list(names: DataFrame, cap: int = rules.WATCH_CAP) -> DataFrame:
    """Watch list from ordered names: one row per spelling without case, first ``cap`` kept."""
    clean = (names.withColumn("name", tx.collapse_space("name"))
             .filter(F.length("name").between(1, 120)))
    once = ordered_distinct(clean, ["tenant_id"], "name", ["seq"])
    return first_n_per_key(once, ["tenant_id"], ["seq"], cap, "place")
