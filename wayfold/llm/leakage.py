"""Benchmark decontamination by winnowing.

Of every ``WINDOW - GRAM + 1`` neighbouring k-grams of a text the one of least hash is kept, the last of equals.
Which one that is depends on those ``WINDOW`` words alone, so a span of ``WINDOW`` words that a document and an
item share has the same k-gram kept on both sides: no shared span of that length is missed.  An item of fewer words
than a window is one window itself, kept as its one k-gram of all its words.

1. Items are winnowed to fingerprints with their context: the words, as 64-bit hashes, that a window through the
   k-gram could hold on either side.  Equal fingerprints with equal contexts are one.
2. A bitmap of the fingerprints, of at most ``BITS`` bits whatever the benchmark's size, goes to the tasks that read
   the documents; of a document only the kept k-grams in the bitmap go on, with their context.
3. Fingerprints meet by hash, and a hit is extended over the words on both sides that agree.  Where the run is as
   long as a window, all its words are hit: every window occurrence runs through a kept k-gram, so the runs together
   are all of them.
4. Items that stand behind the same contexts are one group, so that many documents with one passage of
   many items carry the group's number and not the items.

Documents of any size and passages of any number of documents stay rows: nothing is collected but the bitmap.

Defined cases: a null or blank text has no words and no window; a document shorter than a window can hold
only shorter items; equal ids are rows of their own; equal items are each named, rows of one item id are one item,
a null item id is an item with the empty name; an empty table on either side gives documents without hits; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import BROADCAST, byte_table, map_arrow, meet
from wayfold.session import materialize

#: Words of a window and of the k-grams in it.
WINDOW, GRAM = 10, 5
#: Most bits of the bitmap (16 MB), and bits per fingerprint below that.
BITS, BITS_EACH = 1 << 27, 16
#: Words whose hash a task keeps.
KEPT = 300_000

WORDS = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyz")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (constants of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """64-bit hash of a word's bytes, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(WORDS).split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(codes: np.ndarray, size: int, window: int) -> np.ndarray:
    """Hash of every run of ``size`` words; different for other windows."""
    value = np.full(len(codes) - size + 1, window * 64 + size, dtype=np.uint64)
    for k in range(size):
        value = value * MULTIPLIER + codes[k:len(codes) - size + 1 + k]
    return scrambled(value)


def winnowed(hashes: np.ndarray, span: int) -> np.ndarray:
    """Places of the least hash of every ``span`` neighbours, the last of equals, each place once."""
    if len(hashes) < span:
        return np.empty(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], span)  # from the end, so that the first least is the last
    places = len(hashes) - 1 - (np.arange(len(views)) + views.argmin(axis=1))
    return np.unique(places)


def fingerprints(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(words of the k-gram, of the window, places, hashes) for the long windows and each short size."""
    if len(codes) >= WINDOW:
        every = grams(codes, GRAM, WINDOW)
        at = winnowed(every, WINDOW - GRAM + 1)
        yield GRAM, WINDOW, at, every[at]
    for size in sizes:
        if size <= len(codes):
            yield size, size, np.arange(len(codes) - size + 1), grams(codes, size, size)


class Found:
    """Fingerprints of some texts as one Arrow array of lists."""

    def __init__(self):
        self.ends, self.columns = [0], {c: [] for c in ("hash", "pos", "size", "need", "left", "left_n", "right", "right_n")}

    def add(self, codes: np.ndarray, parts) -> None:
        total = 0
        for size, need, at, hashes in parts:
            around = np.arange(need - size)
            before, after = at[:, None] - 1 - around, at[:, None] + size + around
            inside, within = before >= 0, after < len(codes)
            for name, values in (("hash", hashes.view(np.int64)), ("pos", at.astype(np.int32)),
                                 ("size", np.full(len(at), size, np.int32)), ("need", np.full(len(at), need, np.int32)),
                                 ("left", codes[before[inside]].view(np.int64)), ("left_n", inside.sum(axis=1)),
                                 ("right", codes[after[within]].view(np.int64)), ("right_n", within.sum(axis=1))):
                self.columns[name].append(values)
            total += len(at)
        self.ends.append(self.ends[-1] + total)

    def array(self) -> pa.ListArray:
        of = lambda c, kind: np.concatenate([np.empty(0, kind), *self.columns[c]]).astype(kind)
        lists = lambda c: pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(of(c + "_n", np.int64))]).astype(np.int32)), pa.array(of(c, np.int64)))
        each = pa.StructArray.from_arrays(
            [pa.array(of("hash", np.int64)), *(pa.array(of(c, np.int32)) for c in ("pos", "size", "need")), lists("left"), lists("right")],
            names=["hash", "pos", "size", "need", "left", "right"])
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), each)


FOUND = "array<struct<hash:long,pos:int,size:int,need:int,left:array<long>,right:array<long>>>"


def read(table: DataFrame, fitting, schema: str) -> DataFrame:
    """name, n_words and the fingerprints that ``fitting(codes)`` gives for each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            found, sizes = Found(), []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                codes = hashes.of(text)
                sizes.append(len(codes))
                found.add(codes, fitting(codes))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64()), found.array()],
                                             names=["name", "n_words", "found"])

    return map_arrow(table.select("name", "text"), run, schema)


def of_item(codes: np.ndarray):
    return fingerprints(codes, [len(codes)] if 0 < len(codes) < WINDOW else [])


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """64 places a number, a bit set for the low bits of every hash; the driver gets at most ``bits / 64`` rows."""
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    rows = (hashes.select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, cast(hash & 63 AS int))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas())
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[rows["at"].to_numpy(dtype="int64")] = rows["bit"].to_numpy(dtype="int64").view("uint64")
    return out


def agreeing(here: Column, there: Column, most: int) -> Column:
    """How many words agree from the start of two arrays; past the end of one nothing does."""
    run = F.lit(most)
    for k in reversed(range(most)):
        run = F.when(F.get(here, F.lit(k)) == F.get(there, F.lit(k)), run).otherwise(F.lit(k))
    return run


def contexts_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(hash, before, after, group) of every context, (group, name) of the items behind it, and the lengths of short items."""
    items = materialize(read(benchmark, of_item, f"name string, n_words long, found {FOUND}")
                        .select("name", F.col("n_words").cast("int").alias("n_words"), F.inline("found")), "item-fingerprints")
    alike = ["hash", "left", "right"]
    names = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("name").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(7), "name")))
    behind = materialize(items.select(*alike, "name").distinct().groupBy(*alike).agg(names.alias("names"))
                         .withColumn("context", F.monotonically_increasing_id()), "contexts")
    contexts = materialize(behind.join(behind.groupBy("names").agg(F.min("context").alias("group")), "names")
                           .drop("names"), "context-groups")
    members = materialize(items.join(contexts.where("context = group"), alike).select("group", "name").distinct(), "group-items")
    short = [r[0] for r in items.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect()]  # less than WINDOW
    return contexts.select("hash", F.col("left").alias("before"), F.col("right").alias("after"), "group"), members, sorted(short)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id",
          item_text: str = "text", most: int = BROADCAST) -> DataFrame:
    """id, n_words, n_hit, spans (start and end of each hit run of words) and items (sorted names) of every row."""
    contexts, members, short = contexts_of(benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(item_text).alias("text")))
    contexts = materialize(contexts, "contexts-by-hash")
    bits = 1 << 16
    while bits < min(BITS, BITS_EACH * contexts.count()):
        bits *= 2
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(contexts.select("hash"), bits))  # at most BITS bits

    def in_bitmap(codes: np.ndarray):
        marks = shared.value
        for size, need, at, hashes in fingerprints(codes, short):
            low = hashes & np.uint64(bits - 1)
            known = (marks[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1
            yield size, need, at[known], hashes[known]

    kind = docs.schema[id_col].dataType.simpleString()
    facts = read(docs.select(F.col(id_col).alias("name"), F.col(text).alias("text")), in_bitmap, f"name {kind}, n_words long, found {FOUND}")
    facts = materialize(facts.withColumns({"row": F.monotonically_increasing_id(), "n_found": F.size("found")}), "document-fingerprints")

    met = meet(facts.where("n_found > 0").select("row", F.inline("found")), contexts, ["hash"], most)
    before, after = (agreeing(F.col(a), F.col(b), WINDOW - GRAM) for a, b in (("left", "before"), ("right", "after")))
    runs = (met.withColumns({"start": F.col("pos") - before, "end": F.col("pos") + F.col("size") + after})
            .where(F.col("end") - F.col("start") >= F.col("need")).select("row", "start", "end", "group"))
    in_row = Window.partitionBy("row").orderBy("start", "end")
    before_end = F.max("end").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    spans = (runs.withColumn("opens", F.when(F.col("start") <= before_end, 0).otherwise(1))
             .withColumn("span", F.sum("opens").over(in_row.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("group").alias("groups")))
    hit = materialize(spans.groupBy("row").agg(
        F.sum((F.col("end") - F.col("start")).cast("long")).alias("n_hit"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("groups")), "hit-rows")

    # documents with the same groups have the same items: these are listed once for all of them
    listed = meet(hit.select("groups").distinct().select("groups", F.explode("groups").alias("group")), members, ["group"], most)
    listed = materialize(listed.groupBy("groups").agg(F.array_sort(F.collect_set("name")).alias("items")), "item-lists")
    found = meet(hit, listed, ["groups"], most).drop("groups")
    seen = facts.where("n_found > 0").select("row", "name", "n_words").join(found, "row", "left")
    clean = facts.where("n_found = 0").select("row", "name", "n_words")
    return (seen.unionByName(clean, allowMissingColumns=True)
            .select(F.col("name").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))
