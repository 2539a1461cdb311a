"""N-gram Jaccard join, size-aware and heavy-light, down to the components of linked documents.

1. Documents with one and the same shingle set are a class; classes are joined, not copies.
2. Small sets (up to a boundary) enumerate their subsets of the sizes at which they can overlap a
   partner; two small sets that link share such a subset.  The boundary is where the cost
   of enumerating, from the histogram of small sizes, passes that of scanning lists.
3. Larger sets, and the small ones that can link to them, are filed in inverted lists under the
   first shingles of a global order; two sets that link share at least ``shared_least`` of
   them.  The order puts heavy shingles last: those found in many documents by counting
   in every task (at most ``HEAVY`` of them; which ones decides the cost, never the result).
4. First each class is held against the few pivots it shares most lists with.  Links found
   join classes to components.  Where different components still meet in a list, that list gets new pivots, turn by turn
   until few meetings are left or a turn links nothing; a group of near copies is then one component, or few, after a linear
   number of comparisons.  Last, every pair across components that meets early enough in both orders is compared.
   A link inside a component could not change it.

Comparisons are exact on the sets of 64-bit shingle hashes.  Before sets are sent, pairs are held against each other by
parity bitmaps of one to two bits a shingle, whose distance is never above that of the sets: pairs that meet by chance end
there, and no pair that links does.  Classes are told apart by 64 bits
of a set's digest.  Lists are streamed in order by key, never collected.

Defined cases: a null or blank text has an empty set and links with nothing; a text of fewer
words than a shingle is one shingle; equal ids are rows of their own and all belong to
the component of that id's texts; a null id is no member of any component (component null); an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import WordHashes, map_batches, most_frequent
from wayfold.llm.components import components
from wayfold.session import discard, materialize

#: Most heavy shingles; a shingle is reported by a task from LOCAL of its documents on; shingles counted at once.
HEAVY, LOCAL, COUNTED = 1 << 20, 3, 2_000_000
#: Largest set whose subsets may be enumerated.
SMALL = 19
#: Buckets of the filter that keeps texts out of the comparison which no pair needs.
BUCKETS = 1 << 18
#: Classes a task remembers, so that copies it has seen file nothing again.
SEEN = 500_000
#: A set of n is filed so deep in its order that it shares 1 + n / SHARE lists with a linked partner.
SHARE = 50
#: Pivots of a list, and those a class is held against.
PIVOTS, PARTNERS = 4, 3
#: Most turns of new pivots for open lists.  A turn that links nothing is the last, and so is one that leaves at most FEW
#: meetings of different components a row.  Both set the cost of the last step, never the result.
TURNS, FEW = 5, 4

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (constants of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes."""
    codes = hashes.of(text)
    if not len(codes):
        return codes
    span = min(width, len(codes))
    value = np.full(len(codes) - span + 1, span, dtype=np.uint64)
    for k in range(span):
        value = value * MULTIPLIER + codes[k:len(codes) - span + 1 + k]
    return np.unique(mixed(value))


def class_of(codes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(codes.tobytes()))))


def parity(codes: np.ndarray) -> bytes:
    """A bit for each value of the last bits of the codes: whether an odd number of codes has it."""
    size = 1 << max(6, (len(codes) - 1).bit_length())
    counts = np.bincount((codes & np.uint64(size - 1)).astype("int64"), minlength=size)
    return np.packbits((counts & 1).astype("uint8")).tobytes()


def distance(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ: at most the codes that only one of the two sets has."""
    a, b = np.frombuffer(x, dtype="uint8"), np.frombuffer(y, dtype="uint8")
    while len(a) != len(b):  # the halves of a parity together are that of one bit less
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def least_overlap(n: int, m: int, percent: int) -> int:
    """The smallest intersection at which sets of n and m shingles link."""
    return -(-percent * (n + m) // (100 + percent))


def shared_least(n: int) -> int:
    """Lists that a set of n shingles shares with any linked partner not smaller than itself."""
    return 1 + n // SHARE


def filed(n: int, percent: int) -> int:
    """Shingles under which a set of n is filed."""
    return min(n, n - -(-percent * n // 100) + shared_least(n))


def subset_sizes(n: int, percent: int) -> list[int]:
    """The overlaps at which a set of n just links to a partner of some size."""
    partners = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sorted({o for m in partners if (o := least_overlap(n, m, percent)) <= min(n, m)})


def boundary(histogram: dict[int, int], list_length: float, percent: int) -> int:
    """The size up to which enumerating costs less than scanning lists, over all sets of at most SMALL shingles."""
    def cost(x: int) -> float:
        return sum(count * (sum(math.comb(n, c) for c in subset_sizes(n, percent)) if n <= x else filed(n, percent) * list_length)
                   for n, count in histogram.items())
    return min(range(0, SMALL + 1), key=lambda x: (cost(x), x))


def facts(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: (id, n, class, parity) per row; kind 1: (shingle, documents) for shingles seen in LOCAL documents at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held, size, seen = WordHashes(), [], 0, set()
        for batch in batches:
            sets = [shingles(t, width, hashes) for t in batch["text"]]
            names = [class_of(s) for s in sets]
            yield pd.DataFrame({"kind": 0, "id": batch["id"], "n": [len(s) for s in sets],
                                "code": names, "bits": [parity(s) if len(s) else None for s in sets]}).astype({"kind": "int32", "n": "int32"})
            for s, name in zip(sets, names):
                if name in seen:
                    continue  # a copy: it is joined as its class
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield _heavy(held)
                    held, size = [], 0
        if size:
            yield _heavy(held)

    return map_batches(docs, run, "kind int, id long, n int, code long, bits binary")


def _heavy(sets: list[np.ndarray]) -> pd.DataFrame:
    codes, counts = np.unique(np.concatenate(sets), return_counts=True)
    keep = counts >= LOCAL
    return pd.DataFrame({"kind": np.int32(1), "id": pd.Series([None] * int(keep.sum()), dtype="Int64"),
                         "n": counts[keep].astype("int32"), "code": codes[keep].view("int64"), "bits": None})


def in_order(codes: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set in the global order: light shingles by hash, then heavy ones from rarest to most frequent."""
    if not len(heavy):
        return codes
    at = np.minimum(np.searchsorted(heavy, codes), len(heavy) - 1)
    is_heavy = heavy[at] == codes
    last = codes[is_heavy]
    return np.concatenate([codes[~is_heavy], last[np.argsort(rank[at[is_heavy]], kind="stable")]])


def subset_keys(codes: np.ndarray, percent: int) -> list[int]:
    scrambled = [int(x) for x in mixed(codes + np.uint64(1))]
    return [xxhash.xxh64_intdigest(f"{c}:{sum(part) % 2 ** 64}") for c in subset_sizes(len(codes), percent)
            for part in combinations(scrambled, c)]


def postings(docs: DataFrame, width: int, percent: int, limit: int, heavy: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(key, class, n, pos): the lists that each class is filed in, and the key's place in the class's order."""
    shared = docs.sparkSession.sparkContext.broadcast((heavy, rank))  # at most HEAVY pairs of numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heavy, rank = shared.value
        hashes, seen = WordHashes(), set()
        for batch in batches:
            keys, classes, sizes, places = [], [], [], []
            for text in batch["text"]:
                codes = shingles(text, width, hashes)
                n, name = len(codes), class_of(codes)
                if not n or name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                found = []
                if n <= limit:
                    found.append(np.array(subset_keys(codes, percent), dtype=np.uint64))
                if 100 * n >= percent * (limit + 1):
                    found.append(in_order(codes, heavy, rank)[:filed(n, percent)])
                total = sum(map(len, found))
                keys += found
                # a subset of a small set stands first in every order
                places += [np.arange(len(f), dtype=np.int32) * (k > 0 or n > limit) for k, f in enumerate(found)]
                classes.append(np.full(total, name))
                sizes.append(np.full(total, n, dtype=np.int32))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys).view("int64"), "cls": np.concatenate(classes),
                                    "n": np.concatenate(sizes), "pos": np.concatenate(places)})

    return map_batches(docs, run, "key long, cls long, n int, pos int")


def near(pairs: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose parities are no further apart than those of sets that link."""
    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            close = [distance(x, y) <= n + m - 2 * least_overlap(n, m, percent)
                     for x, y, n, m in zip(batch["x"], batch["y"], batch["n"].tolist(), batch["m"].tolist())]
            yield batch.loc[close, ["a", "b"]]

    both = (pairs.join(one.select(F.col("cls").alias("a"), "n", F.col("bits").alias("x")), "a")
            .join(one.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b"))
    return map_batches(both.select("a", "b", "n", "m", "x", "y"), hold, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, one: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets link.  ``one`` holds a document id, the size and the parity of each class."""
    pairs = materialize(near(pairs, one, percent), "near-pairs")
    one = one.select("cls", "id")
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct().join(one, "cls")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    wanted = docs.join(F.broadcast(needed.select(bucket("id").alias("bucket")).distinct()),  # at most BUCKETS numbers
                       bucket("id") == F.col("bucket"), "left_semi").select("id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, width, hashes) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "cls": [class_of(s) for s in sets], "codes": [s.tobytes() for s in sets]})

    sets = (map_batches(wanted, run, "id long, cls long, codes binary").join(needed, ["id", "cls"], "left_semi")
            .select("cls", "codes").dropDuplicates(["cls"]))

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = []
            for x, y in zip(batch["x"], batch["y"]):
                a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                links.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.loc[links, ["a", "b"]]

    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("codes").alias("x")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("codes").alias("y")), "b").select("a", "b", "x", "y")
    return map_batches(both, hold, "a long, b long")


def fits(n: Column, m: Column, percent: int) -> Column:
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def meeting(n: Column, m: Column, pos: Column, at: Column, percent: int) -> tuple[Column, Column]:
    """Whether a list in which two classes stand at these places counts for their link, and how many such lists a link needs.

    With an overlap of o the first k common shingles stand before place n - o + k of a set of n, since
    o - k more must follow; so lists are met only up to that place on either side.
    """
    least = F.floor(F.least(n, m) / SHARE) + 1
    need = F.ceil(F.lit(percent) * (n + m) / (100 + percent))
    return fits(n, m, percent) & (pos < n - need + least) & (at < m - need + least), least


def pivot_pairs(placed: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): each class with up to PARTNERS pivots of other components that it shares most lists with, as many as a link needs.

    A list has PIVOTS pivots: of the classes that meet others in the greatest share of their lists, and so lie in the
    middle of their group, those of smallest hash under as many hash functions.  A class that is a pivot
    here is likely one in the other lists of its group too.  Every turn has hash functions of its own.  Which pairs are held
    against each other here decides the cost of the last step, never the result.
    """
    pick = [F.min(F.struct((-F.col("middle")).alias("col1"), F.xxhash64(F.lit(k + turn * PIVOTS), "cls").alias("h"), F.col("cls").alias("b"), F.col("n").alias("m"),
                           F.col("pos").alias("at"), F.col("root").alias("other"))) for k in range(PIVOTS)]
    pivots = placed.groupBy("key").agg(F.array_distinct(F.transform(F.array(*pick), lambda x: x.dropFields("col1", "h"))).alias("pivots"))
    met = placed.join(pivots, "key").select(F.col("cls").alias("a"), "n", "pos", "root", F.inline("pivots"))
    counts, least = meeting(F.col("n"), F.col("m"), F.col("pos"), F.col("at"), percent)
    counted = (met.where((F.col("root") != F.col("other")) & counts).groupBy("a", "b")
               .agg(F.count(F.lit(1)).alias("lists"), F.min(least).alias("least")).where(F.col("lists") >= F.col("least")))
    best = Window.partitionBy("a").orderBy(F.desc("lists"), "b")
    return counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= PARTNERS).select("a", "b")


def pivot_components(links: DataFrame) -> DataFrame:
    """(node, root) for links (a, pivot b): only the pivots, few of each group, are folded by rounds."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    core = (links.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", F.col("m").alias("b"))))
    folded = components(core)
    ends = low.join(folded.select(F.col("node").alias("m"), "root"), "m", "left").select(
        F.col("a").alias("node"), F.coalesce("root", "m").alias("root"))
    alone = links.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return (ends.union(folded).union(alone.join(folded, "node", "left_anti")).groupBy("node").agg(F.min("root").alias("root")))


def open_lists(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists in which different components meet, each row with its component."""
    placed = shared.drop("root").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return materialize(placed.join(keys, "key", "left_semi").select("key", "cls", "n", "pos", "middle", "root"), "open-lists")


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after links (a, b) between classes of different components."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    between = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
               .select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).distinct())
    tops = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialize(moved.union(tops.select(F.col("root").alias("node"), F.col("top").alias("root"))).distinct(), "roots")


def meetings(placed: DataFrame, percent: int) -> int:
    """How often two classes of different components stand in one list, each as early as a link to its like needs."""
    early = placed.where(F.col("pos") < F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent)) + 1)
    parts = early.groupBy("key", "root").agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("c"))
    each = parts.groupBy("key").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("own"))
    return int(each.agg(F.sum(((F.col("all") * F.col("all") - F.col("own")) / 2).cast("decimal(38,0)"))).first()[0] or 0)


def cross_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of classes in different components whose first common shingle may stand where a link needs it.

    With an overlap of o it stands before place n - o + 1 on either side.  Texts that share a frequent passage and too
    little else have it later, so they do not meet here, however many they are.
    """
    x, y = placed.alias("x"), placed.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    need = F.ceil(F.lit(percent) * (n + m) / (100 + percent))
    early = fits(n, m, percent) & (F.col("x.pos") < n - need + 1) & (F.col("y.pos") < m - need + 1)
    return (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & early)
            .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct())


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    seen = materialize(facts(docs, width), "shingle-facts")
    rows = seen.where("kind = 0").select("id", "n", F.col("code").alias("cls"))
    often = most_frequent(seen.where("kind = 1").groupBy("code").agg(F.sum("n").alias("n")), "n", HEAVY).toPandas()  # bounded
    often = often.sort_values(["n", "code"], ascending=[False, True])
    counts = often["n"].to_numpy(dtype="float64")
    total = rows.agg(F.sum("n")).first()[0] or 1
    histogram = {r["n"]: r["count"] for r in rows.where((F.col("n") > 0) & (F.col("n") <= SMALL)).groupBy("n").count().collect()}
    limit = boundary(histogram, 1 + float((counts * (counts - 1)).sum()) / total, percent)
    codes = often["code"].to_numpy(dtype="int64").view("uint64")
    by_code = np.argsort(codes)
    rank = np.arange(len(codes), 0, -1)[by_code]  # the most frequent is last

    lists = postings(docs, width, percent, limit, codes[by_code], rank)
    in_list = Window.partitionBy("key").orderBy("cls")
    met = lists.withColumns({"before": F.lag("cls").over(in_list), "after": F.lead("cls").over(in_list)})
    met = materialize(met.where((F.col("before") != F.col("cls")) | (F.col("after") != F.col("cls")))
                      .select("key", "cls", "n", "pos").distinct(), "met-lists")
    # a class that meets others in fewer lists than it must share with its smallest possible partner has no link
    able = (met.groupBy("cls").agg(F.count(F.lit(1)).alias("lists"), F.first("n").alias("n"))
            .where(F.col("lists") >= 1 + F.floor(F.lit(percent) * F.col("n") / (100 * SHARE)))
            .select("cls", F.floor(8 * F.col("lists") / F.expr(f"n - ceil({percent} * n / 100) + 1 + floor(n / {SHARE})")).alias("middle")))
    shared = materialize(met.join(able, "cls").withColumn("root", F.col("cls")), "shared-lists")
    discard(met)

    one = materialize(seen.where("kind = 0 and n > 0 and id is not null").groupBy(F.col("code").alias("cls"))
                      .agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("bits").alias("bits")), "classes")
    for turn in range(TURNS):
        pairs = materialize(pivot_pairs(shared, percent, turn), "pivot-pairs")
        links = materialize(verified(pairs, docs, one, width, percent), "pivot-links")
        none = links.isEmpty()
        roots = joined_roots(roots, links) if turn else materialize(pivot_components(links), "roots")
        discard(pairs, links)
        left = open_lists(shared, roots)
        discard(shared)
        shared = left
        if none or meetings(shared, percent) <= FEW * shared.count():
            break
    pairs = materialize(cross_pairs(shared, percent), "cross-pairs")
    roots = joined_roots(roots, materialize(verified(pairs, docs, one, width, percent), "cross-links"))
    discard(shared, pairs)

    placed = rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "root", F.when(F.col("n") > 0, F.coalesce("root", "cls")))
    smallest = placed.where("root is not null").groupBy("root").agg(F.min("id").alias("low"))
    return placed.join(smallest, "root", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component_id"))
