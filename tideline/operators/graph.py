"""Connected components, the one iterative primitive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.spread import HOT_ROWS, HOT_SHARE, spread_join
from tideline.storage import materialise


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """The number of edges, a hash of them all and the largest degree of a node."""
    ends = edges.select("u", F.xxhash64("u", "v").cast("decimal(38,0)").alias("h")).unionByName(edges.select(F.col("v").alias("u"), F.lit(None).cast("decimal(38,0)").alias("h")))
    nodes = ends.groupBy("u").agg(F.count(F.lit(1)).alias("d"), F.count("h").alias("n"), F.sum("h").alias("h"))
    row = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).alias("h"), F.coalesce(F.max("d"), F.lit(0)).alias("d")).first()
    return row["n"], int(row["h"]), row["d"]


def _join(many: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    return spread_join(many, least, ["u"], F.col("v")) if hubs else many.join(least, "u")


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _join(both.where("v > u"), least, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = _join(down, least, hubs)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int | None = None, written: bool = False) -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star rounds: the number of rounds grows with the logarithm of the longest path, and each
    round's edges are written to the shared folder, so a lost executor costs one round. A hub's edges are dealt to several
    tasks. Rounds go on until nothing changes;
    with ``max_rounds``, a graph that needs more raises ``RuntimeError`` rather than return parts of components.
    Null ends are left out; a node with only a self-loop is its own component. ``written`` says that ``edges`` is a written
    table, which need not be written again.
    """
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = clean if written else materialise(clean, "cc-input")
    now = materialise(nodes.where("u <> v").distinct(), "cc-edges")
    was, rounds = _state(now), 0
    while was[0]:
        if rounds == max_rounds:
            raise RuntimeError(f"components not found within {max_rounds} rounds")
        hubs = was[2] > max(HOT_ROWS, HOT_SHARE * was[0])  # no node's degree grows within a round
        large = _large_star(now, hubs)
        now = materialise(_small_star(materialise(large, "cc-edges") if hubs else large, hubs), "cc-edges")
        new, rounds = _state(now), rounds + 1
        if new[:2] == was[:2]:
            break
        was = new
    every = nodes.select(F.col("u").alias("node")).unionByName(nodes.select(F.col("v").alias("node"))).distinct()
    return every.join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
