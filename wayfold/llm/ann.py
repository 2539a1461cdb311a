"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are rotated at random, so that every dimension says about as much as any other, and
filed in the lists of a k-means index.  A list lies in column blocks: a query reads a few
dimensions of all its vectors first, and a hypothesis test on the partial distance gives up
those that are unlikely to come under the distance of the best found so far; only the others
are read further.  What survives is measured exactly on the original vectors.

The index (centroids, rotation) is fitted on at most ``SAMPLE`` vectors or ``SAMPLE_VALUES``
numbers, the vectors of smallest hash; every vector is filed.  Lists and their queries are cut
into chunks by count, so that no task gets a hot list whole.  Equal vectors answer alike: a
candidate vector is kept with its k + 1 smallest ids (ranked before the shuffle), an equal
query is asked once, so copies of one vector cost no pairs of their own.  A query probes the
nearest lists: as many as the true neighbours inside the sample would have taken (``SHARE_MET``), and
more where they do not hold enough vectors for a full answer.

Defined cases: vectors that are null, all zero, or hold a null or non-finite number take no
part; nor do those whose length is not the commonest (ties: the longer); repeated rows (same id and
vector) count once, as candidates and as queries; rows with the query's own id are no candidates and
take no places; equal ids with other vectors are candidates each, and queries each; fewer candidates than
k give them all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import map_batches, ship

SAMPLE, SAMPLE_VALUES = 20_000, 4_000_000
MAX_LISTS = 1024
#: Share of the sample's true neighbours whose list must be probed, and the sample queries that show how many lists that takes.
SHARE_MET, TRIALS = 0.97, 256
#: Dimensions per column block, and the test's width: 2.1 standard deviations of a partial distance.
BLOCK, WIDTH = 16, 2.1
#: Vectors read before the bound is renewed; most vectors and queries in a chunk.
TILE, CHUNK, QUERIES = 256, 4096, 2048


def taking_part(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def k_means(points: np.ndarray, lists: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = points[np.sort(rng.choice(len(points), lists, replace=False))].copy()
    for _ in range(rounds):
        owner = nearest(points, centers)
        sums, counts = np.zeros_like(centers), np.bincount(owner, minlength=lists)
        np.add.at(sums, owner, points)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers ** 2).sum(1)[None, :] - 2 * points @ centers.T, axis=1)


def rotation(size: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def probes_needed(points: np.ndarray, centers: np.ndarray, k: int) -> int:
    """Lists to probe so that SHARE_MET of the k true neighbours of the trial queries, searched in the sample, are met.

    In the whole table neighbours are nearer than in a sample of it, so their lists are met sooner.
    """
    trials = points[np.linspace(0, len(points) - 1, min(TRIALS, len(points))).astype(int)]
    square = (points ** 2).sum(1)[None, :] - 2 * trials @ points.T
    close = np.argpartition(square, min(k, len(points) - 1), axis=1)[:, : k + 1]
    place = np.argsort(np.argsort((centers ** 2).sum(1)[None, :] - 2 * trials @ centers.T, axis=1), axis=1)
    owner = nearest(points, centers)
    ranks = np.sort(np.take_along_axis(place, owner[close], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(SHARE_MET * len(ranks)))]) + 1


def scan(query: np.ndarray, turned: np.ndarray, ids: np.ndarray, vectors: np.ndarray, columns: np.ndarray, k: int, each: int):
    """The k best (distance, id) of a chunk, no id more than ``each`` times; ``columns`` holds the rotated vectors, one row per dimension."""
    size, n = columns.shape
    best_d, best_i = np.empty(0), np.empty(0, dtype=ids.dtype)
    for start in range(0, n, TILE):
        alive = np.arange(start, min(n, start + TILE))
        bound = best_d[k - 1] ** 2 if len(best_d) >= k else np.inf
        partial = np.zeros(len(alive))
        for low in range(0, size, BLOCK):
            high = min(size, low + BLOCK)
            gap = columns[low:high, alive] - turned[low:high, None]
            partial += np.einsum("ij,ij->j", gap, gap)
            if np.isfinite(bound) and high < size:
                keep = partial * (size / high) <= bound * (1 + WIDTH / np.sqrt(high)) ** 2
                alive, partial = alive[keep], partial[keep]
                if not len(alive):
                    break
        if not len(alive):
            continue
        # a rotated distance differs from the true one by rounding alone
        near = alive[partial <= bound * (1 + 1e-9) + 1e-12] if np.isfinite(bound) else alive
        gap = vectors[near] - query
        d = np.concatenate([best_d, np.sqrt((gap * gap).sum(axis=1))])
        i = np.concatenate([best_i, ids[near]])
        order = np.lexsort((i, d))
        if each < k - 1:
            order = first_of_each(order, i, each)
        order = order[:k]
        best_d, best_i = d[order], i[order]
    return best_d, best_i


def first_of_each(order: np.ndarray, ids: np.ndarray, each: int) -> np.ndarray:
    """``order`` without the places of an id after its first ``each``."""
    grouped = np.argsort(ids[order], kind="stable")
    held = ids[order][grouped]
    nth = np.empty(len(order), dtype=np.int64)
    nth[grouped] = np.arange(len(order)) - np.searchsorted(held, held)
    return order[nth < each]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64")


def search(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding",
           probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found of every query row."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"),
                        is_query.alias("asks")).where(taking_part(F.col("v")))
    out = "query_id long, rank int, vec_id long, score double"
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], out)
    size = length["n"]
    rows = rows.where((F.size("v") == size) & F.col("id").isNotNull())
    single = rows.select("id", "v").distinct()
    # a query leaves out the rows of its own id, so that many places more are kept; beyond k rows of an id none is needed
    own = single.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    places = k + min(k, own)
    by_id = Window.partitionBy("v").orderBy("id")
    kept = single.withColumn("copy", F.row_number().over(by_id)).where(F.col("copy") <= k + 1).select("id", "v")
    asked = rows.where("asks").select("v").distinct()

    sample = (single.orderBy(F.xxhash64("id"), "id")
              .limit(max(1, min(SAMPLE, SAMPLE_VALUES // size))).select("v").collect())  # bounded
    points = np.unique(np.array([r["v"] for r in sample]), axis=0)
    turn = rotation(size)
    count = max(1, min(MAX_LISTS, int(np.sqrt(length["count"])), len(points) // 8))
    centers = k_means(points @ turn, count)
    probes = probes or probes_needed(points @ turn, centers, k)
    index = spark.sparkContext.broadcast((turn, centers))  # at most MAX_LISTS rows

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, centers = index.value
        for batch in batches:
            if len(batch):
                yield batch.assign(list=nearest(_matrix(batch["v"]) @ turn, centers).astype("int32"))

    filed = map_batches(kept, file, "id long, v array<double>, list int")
    sizes = {r["list"]: r["count"] for r in filed.groupBy("list").count().collect()}  # at most MAX_LISTS rows
    held = np.array([sizes.get(c, 0) for c in range(count)])
    facts = spark.sparkContext.broadcast((turn, centers, held))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, centers, held = facts.value
        for batch in batches:
            if not len(batch):
                continue
            points = _matrix(batch["v"]) @ turn
            order = np.argsort((centers ** 2).sum(1)[None, :] - 2 * points @ centers.T, axis=1, kind="stable")
            found = np.cumsum(held[order], axis=1)
            need = np.maximum((found < places).sum(axis=1) + 1, probes)
            chosen = [[int(c) for c in row[:n] if held[c]] for row, n in zip(order, need)]
            yield batch.assign(list=chosen).explode("list").astype({"list": "int32"})

    probed = map_batches(asked, probe, "v array<double>, list int")
    waiting = {r["list"]: r["count"] for r in probed.groupBy("list").count().collect()}  # at most MAX_LISTS rows
    cuts = spark.createDataFrame([(c, -(-n // CHUNK), -(-waiting.get(c, 1) // QUERIES)) for c, n in sizes.items()],
                                 "list int, chunks int, turns int")
    left = (filed.join(F.broadcast(cuts), "list")
            .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
            .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select("list", "chunk", "turn", "id", "v"))
    right = (probed.join(F.broadcast(cuts), "list")
             .withColumn("turn", F.pmod(F.xxhash64("v"), F.col("turns")).cast("int"))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("list", "chunk", "turn", "v"))

    def meet(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(candidates) and len(queries):
            turn = facts.value[0]
            vectors, ids = _matrix(candidates["v"]), candidates["id"].to_numpy()
            columns = np.ascontiguousarray((vectors @ turn).T)
            asked = _matrix(queries["v"])
            for raw, q, t in zip(queries["v"], asked, asked @ turn):
                d, i = scan(q, t, ids, vectors, columns, places, k)
                parts.append(pd.DataFrame({"v": [raw] * len(d), "vec_id": i, "score": d}))
        none = pd.DataFrame({"v": pd.Series(dtype="object"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return pd.concat(parts) if parts else none

    ship(spark)
    keys = ("list", "chunk", "turn")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "v array<double>, vec_id long, score double")
    best = Window.partitionBy("v").orderBy("score", "vec_id")
    if own > k:
        of_id = Window.partitionBy("v", "vec_id").orderBy("score")
        found = found.withColumn("place", F.row_number().over(of_id)).where(F.col("place") <= k).drop("place")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= places).drop("place")
    mine = Window.partitionBy("query_id", "v").orderBy("score", "vec_id")
    return (rows.where("asks").select(F.col("id").alias("query_id"), "v").distinct().join(top, "v")
            .where(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
