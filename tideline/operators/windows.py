"""Window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.storage import materialise


def dedupe_latest(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    return latest_per_key(df, keys, [F.col(order).desc_nulls_last(), F.col(tie)])


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def yoy_flags(df: DataFrame, key: str, period: str, columns: list[str]) -> DataFrame:
    """Whether each column equals that of the next older row on record (any gap), null without one."""
    w = W.partitionBy(key).orderBy(F.col(period).desc())
    return df.select("*", *(F.col(c).eqNullSafe(F.lead(c).over(w)).alias(f"same_{c}") for c in columns), F.lead(period).over(w).alias("older"))


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the running sum of ``value`` within ``keys`` in ``order``, this row included.

    Rows are dealt by ranges of (keys, order) and written; each range sums up its own rows and adds the totals of the
    ranges before, so that no task holds a whole key. ``order`` should tell rows of a key apart.
    """
    dealt = df.repartitionByRange(*keys, *order).withColumn("_shard", F.spark_partition_id())
    rows = materialise(dealt, "prefix-sum")
    before = W.partitionBy(*keys).orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_shard").agg(F.sum(value).alias("_t")).select(*keys, "_shard", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    own = F.sum(value).over(W.partitionBy(*keys, "_shard").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(totals, [*keys, "_shard"]).withColumn(out, F.col("_own") + F.col("_offset")).drop("_own", "_offset", "_shard")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, current: bool = True) -> DataFrame:
    """``df`` with the last value of ``value`` that is not null within ``keys`` in ``order``, this row's included (or, without ``current``, left out).

    Rows are dealt by ranges of (keys, order) and written; each range looks back over its own rows, and takes the last value of the ranges before
    where it has none. So no task holds a whole key, however long. ``order`` should tell rows of a key apart.
    """
    rows = materialise(df.repartitionByRange(*keys, *order).withColumn("_shard", F.spark_partition_id()), "carry-forward")
    known = rows.where(F.col(value).isNotNull()).groupBy(*keys, "_shard").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    before = W.partitionBy(*keys).orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    shards = rows.select(*keys, "_shard").distinct().join(known, [*keys, "_shard"], "left").select(*keys, "_shard", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    own = F.last(value, ignorenulls=True).over(W.partitionBy(*keys, "_shard").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if current else -1))
    return rows.withColumn("_own", own).join(shards, [*keys, "_shard"], "left").withColumn(out, F.coalesce("_own", "_before.v")).drop("_own", "_before", "_shard")


def requeue(df: DataFrame, lists: list[str], active: Column, order: list[str]) -> DataFrame:
    """Positions among the active rows; null for inactive ones. A list is numbered by ranges, however long."""
    numbered = prefix_sum(df.withColumn("_a", active.cast("long")), lists, order, "_a", "_n")
    return numbered.withColumn("queue", F.when(F.col("_a") == 1, F.col("_n"))).drop("_a", "_n")


def prior_history(df: DataFrame, keys: list[str], period: str, value: str, gap: int = 2) -> DataFrame:
    """All values at least ``gap`` periods back: their number and median."""
    w = W.partitionBy(*keys).orderBy(period).rangeBetween(W.unboundedPreceding, -gap)
    past = df.withColumn("_p", F.array_sort(F.collect_list(value).over(w)))
    n = F.size("_p")
    mid = (F.get("_p", F.floor((n - 1) / 2).cast("int")) + F.get("_p", F.floor(n / 2).cast("int"))) / 2
    return past.withColumn("prior_n", n).withColumn("prior_median", F.when(n > 0, mid)).drop("_p")


def repeated_value(df: DataFrame, keys: list[str], period: str, values: list[str]) -> DataFrame:
    """Rows whose values all equal those of exactly one period before; a null equals nothing."""
    prev = df.select(*keys, (F.col(period) + 1).alias(period), *values)
    return df.join(prev.distinct(), [*keys, period, *values], "left_semi")


def history_outlier(df: DataFrame, key: list[str], period: str, value: str, factor: float = 2.5, min_n: int = 2) -> DataFrame:
    """Values beyond ``factor`` times the median of at least ``min_n`` earlier ones, either way."""
    h = prior_history(df, key, period, value, gap=1)
    far = (F.col(value) > factor * F.col("prior_median")) | (F.col(value) < F.col("prior_median") / factor)
    return h.where((F.col("prior_n") >= min_n) & far)


def changed_since_last(df: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Rows whose value differs from the last known earlier one."""
    return carry_forward(df, [key], [period], value, "last_known", current=False).where(F.col("last_known") != F.col(value))


def latest_two(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.select(*keys, F.col(value).alias("newest"), F.lead(value).over(w).alias("previous"), F.row_number().over(w).alias("_rn")).where("_rn = 1").drop("_rn")


def series(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    got = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(period, value))).alias("_s"))
    return got.select(*keys, F.array_join(F.transform("_s", lambda s: F.concat(s[period].cast("string"), F.lit("="), s[value].cast("string"))), ";").alias("series"))


def top_contributors(df: DataFrame, key: str, value: str, tie: str, n: int = 3) -> DataFrame:
    w = W.partitionBy(key)
    return df.withColumn("place", F.row_number().over(w.orderBy(F.col(value).desc(), tie))).withColumn("of", F.count(F.lit(1)).over(w)).where(F.col("place") <= n)
