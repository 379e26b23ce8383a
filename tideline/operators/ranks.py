"""Ranks and order statistics of few large groups, by histograms of their values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.windows import prefix_sum
from tideline.storage import materialise


def value_ranks(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """``by, x, n, below, total``: how often each value occurs in its group, how many smaller ones and how many values there are.

    Values are counted first, on the map side; the counts are added up by ranges of (by, x) (``prefix_sum``), so no task sorts a group. Null
    values have no rank; groups are told apart by columns that are not null.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    run = prefix_sum(counts, by, [x], "n", "_upto")
    total = run.groupBy(*by).agg(F.max("_upto").alias("total"))
    return run.join(total, by).select(*by, x, "n", (F.col("_upto") - F.col("n")).alias("below"), "total")


def nearest_quantiles(df: DataFrame, by: list[str], x: str, ps: dict[str, float]) -> DataFrame:
    """The element at index least(n - 1, floor(p n)) of the sorted values; not interpolated."""
    ranks = value_ranks(df, by, x)
    place = lambda p: F.least(F.col("total") - 1, F.floor(F.col("total") * p))
    at = lambda p: F.max(F.when((place(p) >= F.col("below")) & (place(p) < F.col("below") + F.col("n")), F.col(x)))
    return ranks.groupBy(*by).agg(*(at(p).alias(name) for name, p in ps.items()))


def with_average_rank(df: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """``df`` with the rank of ``x`` in its group, ties sharing the mean of their places; rows with a null ``x`` go."""
    ranks = value_ranks(df, by, x).select(*by, x, (F.col("below") + 1 + (F.col("n") - 1) / 2).alias(out))
    return df.join(ranks, [*by, x])


def cohort_score(df: DataFrame, cohort: str, value: str, min_n: int = 8) -> DataFrame:
    """Share of the cohort that a value beats (lower is stronger), ties half; null for small cohorts."""
    above = F.col("total") - F.col("below") - F.col("n")
    score = F.when(F.col("total") >= min_n, 100 * (above + F.col("n") / 2) / F.col("total"))
    return df.join(value_ranks(df, [cohort], value).select(cohort, value, score.alias("score")), [cohort, value])


def prefix_medians(values: DataFrame, asked: DataFrame, by: list[str], at: str, x: str, steps: int = 64, buckets: int = 256) -> DataFrame:
    """``by, at, n, median``: for each row of ``asked`` (by, at) the number and the median of the values of its group at smaller ``at`` (0 to ``steps``);
    rows without any are left out.

    A value is stored once for each level of a binary tree over ``at``, counted by value, and an asked prefix is made of one node of a level
    at most: values are not copied to the prefixes that hold them. First the nodes' counts by bucket of values (by quantiles of all
    values) say which bucket holds the middle, then only that bucket's values are put in order. So a prefix reads its nodes' buckets and
    about one in ``buckets`` of its values.
    """
    levels = steps.bit_length()
    v = values.where(F.col(x).isNotNull()).select(*by, F.col(at).cast("int").alias("_t"), F.col(x).cast("double").alias("_x"))
    cuts = sorted(set(v.approxQuantile("_x", [k / buckets for k in range(1, buckets)], 0.002)))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("_x"))) if cuts else F.lit(0)
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_k")
    own = v.groupBy(*by, "_t", "_x").agg(F.count(F.lit(1)).alias("_f")).select(*by, "_t", "_x", "_f", bucket.alias("_b"), level)
    fine = own.groupBy(*by, "_k", F.expr("shiftright(_t, _k)").alias("_n"), "_b", "_x").agg(F.sum("_f").alias("_f"))
    fine = materialise(fine, "value-nodes")
    coarse = fine.groupBy(*by, "_k", "_n", "_b").agg(F.sum("_f").alias("_f"))

    # The values before t are those of node (t >> k) - 1 of each level k whose bit t has.
    q = asked.select(*by, F.col(at).cast("int").alias("_t")).distinct().where("_t > 0")
    has = F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.call_function("shiftright", F.col("_t"), k) % 2 == 1)
    nodes = q.select(*by, "_t", F.explode(has).alias("_k")).withColumn("_n", F.expr("shiftright(_t, _k) - 1"))
    spread = nodes.join(coarse, [*by, "_k", "_n"]).groupBy(*by, "_t", "_b").agg(F.sum("_f").alias("_f"))
    order = W.partitionBy(*by, "_t").orderBy("_b")
    run = spread.withColumn("_upto", F.sum("_f").over(order)).withColumn("n", F.sum("_f").over(W.partitionBy(*by, "_t")))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    below = F.col("_upto") - F.col("_f")
    middle = run.where((low < F.col("_upto")) & (high >= below)).select(*by, "_t", "_b", "n", below.alias("_below"))
    near = nodes.join(middle, [*by, "_t"]).join(fine, [*by, "_k", "_n", "_b"]).groupBy(*by, "_t", "_b", "n", "_below", "_x").agg(F.sum("_f").alias("_f"))
    upto = F.col("_below") + F.sum("_f").over(W.partitionBy(*by, "_t", "_b").orderBy("_x"))
    put = near.withColumn("_upto", upto)
    holds = lambda i: (i < F.col("_upto")) & (i >= F.col("_upto") - F.col("_f"))
    got = put.groupBy(*by, "_t", "n").agg(F.max(F.when(holds(low), F.col("_x"))).alias("_lo"), F.max(F.when(holds(high), F.col("_x"))).alias("_hi"))
    return got.select(*by, F.col("_t").alias(at), "n", ((F.col("_lo") + F.col("_hi")) / 2).alias("median"))
