"""Merge chains: follow loser -> winner to the surviving row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.session import materialize


def _image_count(ptr: DataFrame) -> int:
    return ptr.select("winner").distinct().count()


def _double(ptr: DataFrame) -> DataFrame:
    """Every pointer moves to its pointer's pointer."""
    hop = ptr.select(F.col("loser").alias("winner"), F.col("winner").alias("__next"))
    return ptr.join(hop, "winner", "left").select(
        "loser", F.coalesce("__next", "winner").alias("winner"))


def _settle(ptr: DataFrame) -> DataFrame:
    """Double until the set of pointed-at rows stops shrinking.

    Chains end on their root.  The images of a step are nested, so two equal
    counts mean that what is left moves only inside cycles.
    """
    seen = _image_count(ptr)
    while True:
        ptr = materialize(_double(ptr), "pointers")
        now = _image_count(ptr)
        if now == seen:
            return ptr
        seen = now


def merge_roots(edges: DataFrame) -> DataFrame:
    """Root of every losing id.  ``edges(loser, winner)`` has one row per loser.

    A row on a cycle is its own root, and a chain that runs into a cycle stops
    at the row where it enters.
    """
    edges = materialize(edges.select("loser", "winner"), "edges")
    settled = _settle(edges)
    losers = edges.select(F.col("loser").alias("winner"))
    on_cycle = settled.join(losers, "winner", "left_semi").select(F.col("winner").alias("loser")).distinct()
    on_cycle = materialize(on_cycle, "cycles")
    open_edges = edges.join(on_cycle, "loser", "left_anti")
    roots = _settle(materialize(open_edges, "edges"))
    return (roots.select("loser", F.col("winner").alias("root"), F.lit(False).alias("on_cycle"))
            .unionByName(on_cycle.select("loser", F.col("loser").alias("root"),
                                         F.lit(True).alias("on_cycle"))))


def live_edges(merge_log: DataFrame) -> DataFrame:
    """Newest merge per loser that was not undone, as edges."""
    from wayfold.operators.latest import newest_per_key
    kept = merge_log.filter(~F.coalesce(F.col("undone"), F.lit(False)))
    return newest_per_key(kept, ["entity_type", "loser_id"], ["seq"], ["winner_id"]).select(
        "entity_type", F.col("loser_id").alias("loser"), F.col("winner_id").alias("winner"))


def reparent(evidence: DataFrame, roots: DataFrame) -> DataFrame:
    """Evidence of a merged row moves to its root."""
    m = roots.select(F.col("loser").alias("entity_id"), "root")
    return (evidence.join(m, "entity_id", "left")
            .withColumn("entity_id", F.coalesce("root", "entity_id")).select(*evidence.columns))
