"""Mixing sources to target weights: exact block quotas, split over shards by a hypergeometric tree.

A source's documents fall into blocks by a hash of their id, so many that a block holds about
``block_words`` words, and a hot source has more blocks than others, none of them large.  A source's target is spent first on whole
epochs (every block once), then on its blocks in permuted order until the target is met; the
last block is met document by document, and its last document in part (or whole, if nearer,
with ``whole=True``).  The draws of all sources are dealt to the output shards by a
tree: at each node the shards are halved and the left half's share of every source is drawn from
the multivariate hypergeometric law, so each shard holds as many draws as any other and its mix
is that of a random deal.  A shard's draws of a source are a run of the permuted order, disjoint
from every other shard's; inside a shard, rows are shuffled by a hash.

The driver holds one row per source (``MAX_SOURCES`` is checked, never cut) and the tree's
quotas.  Everything per document stays in Spark: two aggregations with a map side, by source and
by (source, block), and one window per block.

Defined cases: a null text has no words and is never taken; a null source is a source, last in
order; without any word there is nothing to take and every target is 0; equal ids share a block
and are drawn each on its own; extra columns are kept: where one has the name of a result column, the result's
is written with two underscores before it (names that start so are reserved).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import WORD

MAX_SOURCES = 100_000
#: A document is taken at most so often.
EPOCHS = 3
#: A block has so many words, or more where there would else be over BLOCKS blocks.
BLOCK_WORDS, BLOCKS = 1 << 17, 1 << 20


@dataclass
class Plan:
    source: str | None
    size: int
    target: float
    blocks: int
    words: int = 0
    epochs: int = 0
    rest: int = 0


def targets(sizes: list[int], weights: list[int]) -> list[float]:
    """Shares of the total by weight, none above EPOCHS times its source's size; the excess is shared again by weight.

    With the sources in order of cap per weight, those that stop at their cap are a prefix.
    """
    total = sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (EPOCHS * sizes[i] / weights[i], i))
    left, weight, out = total, sum(weights), [0.0] * len(sizes)
    for place, i in enumerate(order):
        if left * weights[i] <= EPOCHS * sizes[i] * weight:
            for j in order[place:]:
                out[j] = weights[j] * left / weight
            break
        out[i] = float(EPOCHS * sizes[i])
        left -= EPOCHS * sizes[i]
        weight -= weights[i]
    return out


def plan_sources(rows: list[tuple[str | None, int]], block_words: int | None = None) -> list[Plan]:
    """One plan per source, by code point, null last; weights 1, 2, 3 in turn."""
    block_words = block_words or max(BLOCK_WORDS, -(-sum(n for _, n in rows) // BLOCKS))
    rows = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")))
    wanted = targets([n for _, n in rows], [k % 3 + 1 for k in range(len(rows))])
    plans = []
    for (source, size), target in zip(rows, wanted):
        words = min(math.floor(target + 0.5), EPOCHS * size)
        plans.append(Plan(source, size, target, max(1, -(-size // block_words)), words,
                          words // size if size else 0, words % size if size else 0))
    return plans


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Draws of each source per shard, as an array (shard, source).

    A node halves its shards; the left half's draws come from the multivariate hypergeometric law over
    the node's quotas.  Each node has a generator of its own, so a subtree can be drawn anywhere again.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    nodes = [(0, shards, np.array(quotas, dtype=np.int64), 1)]
    while nodes:
        first, width, counts, name = nodes.pop()
        if width == 1:
            out[first] = counts
            continue
        half = width // 2
        take = int(counts.sum()) * half // width
        rng = np.random.Generator(np.random.PCG64([seed, name]))
        left = np.zeros_like(counts)
        rest, need = int(counts.sum()), take
        for k, n in enumerate(counts):  # one source after the other: conditional draws of the joint law
            rest -= int(n)
            left[k] = _hypergeometric(rng, int(n), rest, need)
            need -= int(left[k])
        nodes.append((first, half, left, 2 * name))
        nodes.append((first + half, width - half, counts - left, 2 * name + 1))
    return out


def _hypergeometric(rng, good: int, bad: int, sample: int) -> int:
    if not sample or not good:
        return 0
    if not bad:
        return sample
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    n = good + bad  # beyond the generator's range the law is normal to within a draw
    mean = sample * good / n
    deviation = math.sqrt(max(0.0, mean * (bad / n) * ((n - sample) / (n - 1))))
    return max(0, sample - bad, min(good, sample, round(rng.normal(mean, deviation))))


def mix(docs: DataFrame, shards: int = 64, seed: int = 1, block_words: int | None = None, whole: bool = False,
        id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and ``draws``: an array of (shard, epoch, words) per document."""
    spark = docs.sparkSession
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 15), 16, 10).cast("long")
    sized = docs.withColumns({"__size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"), "__key": key})
    totals = sized.groupBy(F.col(source).cast("string").alias("s")).agg(F.sum("__size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    plans = plan_sources([(r["s"], r["n"]) for r in totals], block_words)
    schema = ("__s string, __source_size long, __target double, __place int, __blocks long, __epochs int, __rest long")
    known = spark.createDataFrame([(p.source, p.size, p.target, k, p.blocks, p.epochs, p.rest) for k, p in enumerate(plans)], schema)
    joined = sized.join(F.broadcast(known), F.col(source).cast("string").eqNullSafe(F.col("__s")))  # at most MAX_SOURCES rows
    joined = joined.withColumn("__block", F.col("__key") % F.col("__blocks"))

    # a block's place in the permuted order of its source, and the words before it
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__place"), F.col("__block")))
    blocks = joined.groupBy("__place", "__block").agg(F.sum("__size").alias("__words")).withColumn("__rank", rank)
    in_order = Window.partitionBy("__place").orderBy("__rank", "__block")
    blocks = blocks.withColumns({
        "__number": F.row_number().over(in_order) - 1,
        "__before": F.sum("__words").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__words")})
    spent = blocks.select(F.col("__place").alias("__p"), F.col("__block").alias("__b"), "__number", "__before")
    joined = joined.join(spent, (F.col("__place") == F.col("__p")) & (F.col("__block") == F.col("__b"))).drop("__p", "__b")

    run = Window.partitionBy("__place", "__block").orderBy("__key", id_col, "__size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__before") + F.coalesce(F.sum("__size").over(run), F.lit(0))
    open_words = F.col("__rest") - start
    if whole:
        part = F.when(2 * open_words >= F.col("__size"), F.col("__size")).otherwise(0)
    else:
        part = F.least(F.greatest(open_words, F.lit(0)), F.col("__size"))
    joined = joined.withColumn("__part", F.when(F.col("__size") > 0, part).otherwise(0).cast("long"))

    # the permuted order of an epoch, one epoch after the other, is dealt to the shards in runs
    rests = known.select(F.col("__place").alias("__p"), "__rest")
    last = (blocks.join(F.broadcast(rests), F.col("__place") == F.col("__p")).where(F.col("__before") < F.col("__rest"))
            .groupBy("__place").count().collect())
    drawn = {r["__place"]: r["count"] for r in last}
    quotas = [p.epochs * p.blocks + drawn.get(k, 0) for k, p in enumerate(plans)]
    ends = np.cumsum(split_tree(quotas, shards, seed), axis=0) if plans else np.zeros((shards, 0), dtype=np.int64)
    bounds = spark.createDataFrame([(k, [int(x) for x in ends[:, k]]) for k in range(len(plans))], "__q int, __ends array<long>")
    joined = joined.join(F.broadcast(bounds), F.col("__place") == F.col("__q"))

    def draw(epoch: int):
        words = F.when(F.lit(epoch) < F.col("__epochs"), F.col("__size")).when(F.lit(epoch) == F.col("__epochs"), F.col("__part"))
        number = F.lit(epoch).cast("long") * F.col("__blocks") + F.col("__number")
        shard = F.least(F.size(F.filter("__ends", lambda e: e <= number)), F.lit(shards - 1))
        return F.when(words > 0, F.struct(shard.alias("shard"), F.lit(epoch).alias("epoch"), words.alias("words")))

    draws = F.filter(F.array(*[draw(e) for e in range(EPOCHS)]), lambda x: x.isNotNull())
    measures = [F.col("__" + c).alias(_free(c, docs.columns)) for c in ("size", "source_size", "target", "draws")]
    return joined.withColumn("__draws", draws).select(*docs.columns, *measures, "__key")


def _free(name: str, columns: list[str]) -> str:
    """The name of a result column beside the input's."""
    return "__" + name if name.lower() in {c.lower() for c in columns} else name


def shuffled(mixed: DataFrame, columns: list[str], seed: int = 1) -> DataFrame:
    """One row per draw with its shard and epoch, each shard shuffled on its own: sorted by a hash inside its partitions."""
    rows = mixed.select(*columns, "__key", F.explode("__draws" if "__draws" in mixed.columns else "draws").alias("__draw"))
    rows = rows.withColumn("__order", F.xxhash64(F.lit(seed), "__key", "__draw.epoch"))
    return (rows.repartition(F.col("__draw.shard"), F.pmod("__order", F.lit(8))).sortWithinPartitions("__draw.shard", "__order")
            .select(*columns, F.col("__draw.shard").alias(_free("shard", columns)), F.col("__draw.epoch").alias(_free("epoch", columns)),
                    F.col("__draw.words").alias(_free("words", columns))))
