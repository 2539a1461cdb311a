"""Which names occur in which texts, without comparing every pair.

A name can only occur where a piece of it occurs.  A text is cut into its
distinct words and the runs between them, and pieces meet names on equi-joins:

* a name with three or more words is anchored on an inner word.  That word has
  its own separators inside the name, so it is a whole word of any text that
  holds the name.  The inner word that the fewest names share is taken.
* any other name is anchored on its longest word, which lies inside one word of
  the text; anchors are first matched against the vocabulary of all texts,
  which grows far slower than the texts do.

Candidates carry keys and a hash of the name only; the names are looked up by
it where the candidates of a text have met, and go to the whole text.  Two names of one
hash are both looked for.
The join side is left to Spark: a small name list is broadcast by its measured
size, a large one is shuffled and split by AQE where it is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.text import cut_around
from wayfold.operators.latest import first_n_per_key
from wayfold.session import keep, spread

GRAMS = (8, 4, 2, 1)
WORD = r"(?U)[\p{Alnum}]+"
PIECE = r"(?U)\p{Alnum}+|[^\p{Alnum}]+"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _pieces(text: Column) -> Column:
    """Distinct words and the runs between them."""
    return F.array_distinct(_all(text, PIECE))


def _grams(text: Column) -> Column:
    """Distinct character runs of the ladder lengths, found by a moving look-ahead."""
    return F.array_distinct(F.concat(*[
        F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in GRAMS]))


def inside(words: DataFrame, anchors: DataFrame, word: str, anchor: str) -> DataFrame:
    """(word, anchor) pairs where the word holds the anchor; both are short strings.

    They meet on the first 8, 4, 2 or 1 characters of the anchor.
    """
    size = F.length(anchor)
    width = F.when(size >= 8, 8).when(size >= 4, 4).when(size >= 2, 2).otherwise(1)
    head = anchors.select(anchor, F.substring(F.col(anchor), F.lit(1), width).alias("__gram"))
    offered = words.select(word, F.explode(_grams(F.col(word))).alias("__gram"))
    return offered.join(head, "__gram").filter(F.contains(word, anchor)).select(word, anchor)


def _inner_anchors(names: DataFrame, scope: Sequence[str]) -> DataFrame:
    each = names.filter(F.size("__words") >= 3).select(*scope, "__id", "__fold", F.explode(F.array_distinct(
        F.slice("__words", 2, F.size("__words") - 2))).alias("__piece"))
    shared = each.groupBy(*scope, "__piece").agg(F.count("*").alias("__n"))
    return each.join(shared, [*scope, "__piece"]).groupBy(*scope, "__id", "__fold").agg(
        F.min_by("__piece", F.struct("__n", -F.length("__piece"), "__piece")).alias("__piece")).select(*scope, "__id", "__piece")


#: Names that are checked together against one text.
TOGETHER = 500
#: Pieces with their names up to which they are sent to the texts' pieces.
SENT = 200_000


def contains_join(texts: DataFrame, names: DataFrame, key: Sequence[str], text: str, name: str,
                  scope: Sequence[str] = (), excerpt_width: int | None = None) -> DataFrame:
    """All (text row, name row) pairs where the text holds the name, case ignored.

    ``key`` identifies a text row together with ``scope``; scope columns (a tenant,
    for example) must be equal on both sides.  All other columns need distinct names.

    A text is read twice: once for its pieces, which are written once as (key, piece), and once for the check.
    There it meets the short names that may be in it, grouped per text, so it moves once and not once per
    pair; what goes on is the place found (``at``, from 1), the ``excerpt`` cut there if asked for, and the text row's
    other columns, but not the text.
    """
    scope, key = list(scope), list(key)
    folded = names.withColumn("__fold", F.lower(name)).filter(F.length("__fold") > 0)
    distinct = folded.select(*scope, "__fold").distinct().withColumns({"__words": _all(F.col("__fold"), WORD), "__id": F.xxhash64("__fold")})

    offered = keep(spread(texts).filter(F.col(text).isNotNull())
                   .select(*scope, *key, F.explode(_pieces(F.lower(text))).alias("__piece")))
    longest = F.coalesce(F.try_element_at(F.array_sort(
        F.transform("__words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(1))["w"], F.col("__fold"))
    short = distinct.filter(F.size("__words") < 3).select(*scope, "__id", longest.alias("__anchor"))
    vocabulary = offered.select("__piece").distinct()
    held = inside(vocabulary, short.select("__anchor").distinct(), "__piece", "__anchor")
    meeting = keep(_inner_anchors(distinct, scope).unionByName(
        short.join(held, "__anchor").select(*scope, "__piece", "__id")))
    # counted, as the optimizer cannot know it; else the pieces of all texts would move to meet a few
    if meeting.limit(SENT + 1).count() <= SENT:
        meeting = F.broadcast(meeting)

    # candidates move once, by text; one that may hold very many names is checked in several rows, each with a bounded list
    pairs = offered.join(meeting, [*scope, "__piece"]).select(*scope, *key, "__id").repartition(*scope, *key)
    size = F.ceil(F.count("*").over(Window.partitionBy(*scope, *key)) / TOGETHER)
    part = F.pmod(F.xxhash64("__id"), size).alias("__part")
    asked = (pairs.select(*scope, *key, "__id", part).distinct().join(distinct.select(*scope, "__id", "__fold"), [*scope, "__id"])
             .groupBy(*scope, *key, "__part").agg(F.collect_list("__fold").alias("__folds")))
    low = texts.join(asked, [*scope, *key]).withColumn("__low", F.lower(text))
    places = F.filter(F.transform("__folds", lambda f: F.struct(f.alias("__fold"), F.instr(F.col("__low"), f).alias("at"))), lambda p: p["at"] > 0)
    found = low.withColumn("__places", places)
    if excerpt_width is not None:
        found = found.withColumn("__places", F.transform("__places", lambda p: F.struct(
            p["__fold"].alias("__fold"), p["at"].alias("at"),
            cut_around(F.col(text), F.col("__low"), p["__fold"], p["at"], excerpt_width).alias("excerpt"))))
    rest = [c for c in texts.columns if c not in (text, *scope, *key)]
    return found.select(*scope, *key, *rest, F.inline("__places")).join(folded, [*scope, "__fold"]).drop("__fold")


def term_search(pages: DataFrame, queries: DataFrame, page_id: str, text: str, query_id: str,
                query: str, limit: int) -> DataFrame:
    """The first ``limit`` pages per query by how many query terms occur in them (as substrings).

    A repeated term counts each time.  A term is made of word characters only, so
    it lies inside one word of the text.  See :func:`ranked` for the search.
    """
    from wayfold.functions.text import search_terms, tokens
    asked = keep(queries.select(query_id, F.explode(search_terms(query)).alias("term"))
                 .groupBy(query_id, "term").agg(F.count("*").alias("times")))
    words = keep(spread(pages).select(page_id, F.explode(F.array_distinct(tokens(text))).alias("word")))
    hits = inside(words.select("word").distinct(), asked.select("term").distinct(), "word", "term")
    sets = words.join(hits, "word").groupBy(page_id).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return ranked(folded_sets(sets, page_id, limit), asked, page_id, query_id, limit)


def folded_sets(sets: DataFrame, page_id: str, limit: int) -> DataFrame:
    """The first ``limit`` pages of each term set: a score depends on the set alone, so no other page of it can come in."""
    return keep(first_n_per_key(sets, ["terms"], [page_id], limit, "place").drop("place"))


def candidates(shown: DataFrame, asked: DataFrame, page_id: str, query_id: str, limit: int) -> DataFrame:
    """(query, page) pairs among which the first ``limit`` pages of every query are.

    The first pages of each single term are scored first; the worst score of a query's ``limit`` best among them is
    its bar.  A query's terms are then taken from the rarest on, and as soon as all that are left could not
    reach the bar together they are not searched: a page with only such terms is out.  A page with only the most
    frequent term is out at a bar of that term's own weight too, unless it is among the first pages of that term.
    """
    postings = shown.select(page_id, F.explode("terms").alias("term"))
    near = (first_n_per_key(postings, ["term"], [page_id], limit, "place").join(asked, "term")
            .select(query_id, page_id).distinct())
    best = first_n_per_key(scored(near, shown, asked, page_id, query_id), [query_id], [F.col("score").desc(), page_id], limit)
    bar = best.filter(F.col("rank") == limit).select(query_id, F.col("score").alias("bar"))
    rarest = Window.partitionBy(query_id).orderBy("pages", "term")
    left = F.sum("times").over(rarest.rowsBetween(0, Window.unboundedFollowing))
    last = F.lead("term").over(rarest).isNull()
    terms = (asked.join(postings.groupBy("term").agg(F.count("*").alias("pages")), "term")
             .withColumns({"left": left, "last": last}).join(bar, query_id, "left"))
    needed = terms.filter(F.col("bar").isNull() | (F.col("left") > F.col("bar")) | ((F.col("left") == F.col("bar")) & ~F.col("last")))
    return near.union(needed.join(postings, "term").select(query_id, page_id)).distinct()


def scored(pairs: DataFrame, shown: DataFrame, asked: DataFrame, page_id: str, query_id: str) -> DataFrame:
    """Score of each (query, page) pair from the query's terms, few as they are, and the page's set."""
    wanted = asked.groupBy(query_id).agg(F.collect_list(F.struct("term", "times")).alias("wanted"))
    score = F.aggregate("wanted", F.lit(0).cast("bigint"), lambda total, w: total + F.when(F.array_contains("terms", w["term"]), w["times"]).otherwise(0))
    return pairs.join(shown, page_id).join(wanted, query_id).select(query_id, page_id, score.alias("score"))


def ranked(shown: DataFrame, asked: DataFrame, page_id: str, query_id: str, limit: int) -> DataFrame:
    """query, page, score and rank; equal scores by page."""
    pairs = candidates(shown, asked, page_id, query_id, limit)
    return first_n_per_key(scored(pairs, shown, asked, page_id, query_id), [query_id], [F.col("score").desc(), page_id], limit)
