"""Orders, top-k, paging and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import levels
from tideline.functions.geo import haversine_km


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def numbered(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows with their position: a distributed top-k first, so the window sees ``n`` rows only."""
    return top_n(df, order, n).withColumn("pos", F.row_number().over(W.orderBy(*order)).cast("long"))


def prestige_top(df: DataFrame, n: int) -> DataFrame:
    return numbered(df, [levels.level_rank(F.col("level")).desc(), F.col("price").desc(), F.col("ed_id")], n)


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows offset + 1 .. offset + size in a deterministic order, and whether more follow."""
    head = numbered(df, order, offset + size + 1)
    total = head.agg(F.max("pos").alias("_last"))
    return head.where(F.col("pos").between(offset + 1, offset + size)).crossJoin(F.broadcast(total)).withColumn("more", F.col("_last") > F.col("pos")).drop("_last")


def seeded_sample(df: DataFrame, key: str, recent: Column, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash, half of them recent ones."""
    tagged = df.withColumn("recent", recent).withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    halves = [tagged.where(c).orderBy("_h", key).limit(n // 2) for c in (F.col("recent"), ~F.col("recent"))]
    return halves[0].unionByName(halves[1]).drop("_h")


def candidates(events: DataFrame, anchor: DataFrame, neighbours: DataFrame, week: int, window: int, n: int, far_km: float = 1500) -> DataFrame:
    """Events near an anchor (one row) by relation, week gap and distance: same city, country, neighbour, region, near."""
    a = F.broadcast(anchor.select(*(F.col(c).alias(f"a_{c}") for c in ("ent", "city", "country", "region", "lat", "lon"))))
    pairs = neighbours.select(F.col("a").alias("a_country"), F.col("b").alias("country"), F.lit(True).alias("_next"))
    near = events.where(F.abs(F.col("wk") - week) <= window).crossJoin(a).where("ent <> a_ent").join(pairs, ["a_country", "country"], "left")
    km = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))
    same = F.col("country") == F.col("a_country")
    tier = F.when(same & (F.col("city") == F.col("a_city")), 0).when(same, 1).when(F.col("_next"), 2).when(F.col("region") == F.col("a_region"), 3).when(km <= far_km, 4)
    out = near.select("ed_id", tier.alias("tier"), F.abs(F.col("wk") - week).alias("gap"), F.round(km, 3).alias("km")).where("tier is not null")
    return top_n(out, [F.col("tier"), F.col("gap"), F.col("km").asc_nulls_last(), F.col("ed_id")], n)
