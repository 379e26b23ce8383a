"""Aggregates and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators import ranks
from tideline.operators.ranks import nearest_quantiles  # noqa: F401


def pivot_facts(df: DataFrame, key: str, value: str) -> DataFrame:
    """One column for each event and draw, their number and whether any value is missing."""
    pick = lambda e, d: F.max(F.when((F.col("ev") == e) & (F.col("dr") == d), F.col(value)))
    return df.groupBy(key).agg(pick("singles", "main").alias("ms"), pick("singles", "qualifying").alias("qs"), pick("doubles", "main").alias("md"), F.count(value).cast("int").alias("n"), F.bool_or(F.col(value).isNull()).alias("gap"))


def coverage_flags(df: DataFrame, key: str, value: str) -> DataFrame:
    """with: every row has a value; null: some row lacks it; missing: none has one."""
    state = F.when(F.count(value) == 0, "missing").when(F.count(value) < F.count(F.lit(1)), "null").otherwise("with")
    return df.groupBy(key).agg(state.alias("coverage"))


def summary_stats(df: DataFrame, by: list[str], x: str, baseline: str) -> DataFrame:
    err = F.abs(F.col(x) - F.col(baseline))
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.median(x).alias("median"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.avg(err).alias("mae"))


def correlation(df: DataFrame, by: list[str], x: str, y: str, method: str = "pearson") -> DataFrame:
    """Pearson, or Spearman with tie-averaged ranks; null for fewer than two rows or no variance."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if method == "spearman":
        both = ranks.with_average_rank(ranks.with_average_rank(both, by, x, "_x"), by, y, "_y")
    else:
        both = both.withColumn("_x", F.col(x).cast("double")).withColumn("_y", F.col(y).cast("double"))
    r = F.when((F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0), F.corr("_x", "_y"))
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r.alias("r"))


def ols_origin(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope through the origin; 0 when all x are 0."""
    sxx = F.sum(F.col(x) * F.col(x))
    return df.groupBy(*by).agg(F.when(sxx == 0, F.lit(0.0)).otherwise(F.sum(F.col(x) * F.col(y)) / sxx).alias("slope"))


def leave_one_out_fits(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """``group, train_n, slope``: the slope through the origin of all other groups' rows."""
    sums = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    total = sums.agg(F.sum("n").alias("tn"), F.sum("sxx").alias("txx"), F.sum("sxy").alias("txy"))
    rest = sums.crossJoin(F.broadcast(total))  # one row
    slope = F.when(F.col("txx") - F.col("sxx") == 0, 0.0).otherwise((F.col("txy") - F.col("sxy")) / (F.col("txx") - F.col("sxx")))
    return rest.select(group, (F.col("tn") - F.col("n")).alias("train_n"), slope.alias("slope"))


def leave_one_out(df: DataFrame, group: str, x: str, y: str, min_train: int = 30) -> DataFrame:
    """For each held-out group the slope of the rest (null below ``min_train`` rows), and the held-out absolute error."""
    fits = leave_one_out_fits(df, group, x, y).withColumn("slope", F.when(F.col("train_n") >= min_train, F.col("slope")))
    return df.join(fits, group).groupBy(group, "train_n", "slope").agg(F.avg(F.abs(F.col(y) - F.col("slope") * F.col(x))).alias("mae"))


def concordance(df: DataFrame, cluster: list[str], id: str, x: str, y: str) -> DataFrame:
    """Share of concordant pairs inside clusters; pairs tied in either value are skipped.

    Pairs are counted, not made. Ranks of x are split by their bits: two different ranks part at exactly one bit, so at each
    bit the rows with a 1 count the rows with a 0 in front of them, in the order of y, among those that agree in the
    higher bits. That takes a row for each bit of the cluster's ranks.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.select(*cluster, (F.dense_rank().over(W.partitionBy(*cluster).orderBy(x)) - 1).alias("_r"), F.col(y).alias("_y"))
    top = ranked.withColumn("_bits", F.length(F.bin(F.max("_r").over(W.partitionBy(*cluster)))))
    level = top.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)))
    shifted = lambda k: F.expr(f"shiftright(_r, {k})")
    level = level.withColumn("_head", shifted("_bit + 1")).withColumn("_one", shifted("_bit") % 2)
    group = W.partitionBy(*cluster, "_bit", "_head").orderBy("_y")
    zeros = (1 - F.col("_one")).cast("long")
    below = F.sum(zeros).over(group.rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum(zeros).over(W.partitionBy(*cluster, "_bit", "_head", "_y"))
    above = F.sum(zeros).over(W.partitionBy(*cluster, "_bit", "_head")) - F.sum(zeros).over(group.rangeBetween(W.unboundedPreceding, W.currentRow))
    counted = level.select(*cluster, "_one", below.alias("_below"), above.alias("_above")).where("_one = 1")
    sums = counted.groupBy(*cluster).agg(F.sum("_below").alias("good"), F.sum("_above").alias("bad")).where("good + bad > 0")
    return sums.select(*cluster, (F.col("good") + F.col("bad")).alias("pairs"), (F.col("good") / (F.col("good") + F.col("bad"))).alias("rate"))


def binned(df: DataFrame, x: str, y: str, width: float, min_n: int, by: list[str] | None = None) -> DataFrame:
    """Fixed-width bins (within ``by``) with at least ``min_n`` rows: median and deviation."""
    bin = (F.floor(F.col(x) / width) * width).cast("long")
    return df.groupBy(*(by or []), bin.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.median(y).alias("median"), F.stddev_samp(y).alias("sd")).where(F.col("n") >= min_n)


def binned_spread(df: DataFrame, x: str, y: str, width: float, min_n: int, by: list[str]) -> DataFrame:
    """``by, bins, spread``: the mean deviation inside the bins of at least ``min_n`` rows over the deviation of all rows; null if that is 0."""
    inside = binned(df, x, y, width, min_n, by).groupBy(*by).agg(F.count(F.lit(1)).alias("bins"), F.avg("sd").alias("_in"))
    whole = df.groupBy(*by).agg(F.stddev_samp(y).alias("_all"))
    return inside.join(whole, by).select(*by, "bins", F.when(F.col("_all") > 0, F.col("_in") / F.col("_all")).alias("spread"))


def error_metrics(pred: str, base: str, actual: str) -> list[Column]:
    """Mean absolute error, bias and win rate against a baseline (ties half)."""
    e, b = F.abs(F.col(pred) - F.col(actual)), F.abs(F.col(base) - F.col(actual))
    win = F.when(e < b, 1.0).when(e == b, 0.5).when(e > b, 0.0)
    return [F.count(e).alias("n"), F.avg(e).alias("mae"), F.avg(b).alias("base_mae"), F.avg(F.col(pred) - F.col(actual)).alias("bias"), F.avg(win).alias("win_rate")]


def slice_summary(df: DataFrame, slices: list[list[str]], metrics: list[Column]) -> DataFrame:
    """The same metrics for several slices in one pass of grouping sets; a column outside its slice is null."""
    cols = sorted({c for s in slices for c in s})
    return df.groupingSets([[F.col(c) for c in s] for s in slices], *cols).agg(F.grouping_id().alias("slice"), *metrics)


def value_drift(df: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Keys with more than one value over time and their history."""
    out = df.groupBy(key).agg(F.count_distinct(value).alias("kinds"), F.array_sort(F.collect_list(F.struct(period, value))).alias("_h")).where("kinds > 1")
    return out.select(key, "kinds", F.array_join(F.transform("_h", lambda h: F.concat(h[period].cast("string"), F.lit(":"), h[value])), ",").alias("history"))


def tier_mix(df: DataFrame, key: str, code: str, rank: Column) -> DataFrame:
    """'2x CODE + 1x OTHER', highest tier first."""
    counts = df.withColumn("_r", rank).groupBy(key, code, "_r").agg(F.count(F.lit(1)).alias("_n"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(code).alias("c"), F.col("_n").alias("n"))))
    text = F.transform("_m", lambda m: F.concat(m["n"].cast("string"), F.lit("x "), m["c"]))
    return counts.groupBy(key).agg(rows.alias("_m")).select(key, F.array_join(text, " + ").alias("mix"))


def tally_routes(df: DataFrame, keys: list[str], route: Column, live: Column) -> DataFrame:
    return df.groupBy(*keys, route.alias("route")).agg(F.sum(live.cast("long")).alias("live"), F.sum((~live).cast("long")).alias("departed"))


def draw_sizes(df: DataFrame, key: str, size: str, round_col: str, qualifying: str) -> DataFrame:
    q = F.col(round_col).rlike(qualifying)
    return df.groupBy(key).agg(F.max(F.when(~q, F.col(size))).alias("main"), F.max(F.when(q, F.col(size))).alias("qual"))


def ordered_collect(df: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(value).alias("v")))).alias("_s")).select(key, F.array_join(F.transform("_s", lambda s: s["v"].cast("string")), ",").alias("ordered"))


def duplicate_groups(df: DataFrame, keys: list[str], id: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(id).alias("first")).where("n > 1")


def climate(targets: DataFrame, daily: DataFrame, seasons: int = 5) -> DataFrame:
    """Averages of the 7 days from the same date in each of the ``seasons`` years before (29 February becomes the 28th)."""
    day = targets.withColumn("_back", F.explode(F.sequence(F.lit(1), F.lit(seasons)))).withColumn("_d0", F.add_months("d", -12 * F.col("_back")))
    window = day.withColumn("day", F.explode(F.sequence("_d0", F.date_add("_d0", 6))))
    return window.join(daily, ["place", "day"]).groupBy("id").agg(F.avg("x").alias("mean_x"), F.count("x").alias("n"))


def collapse_weekly(df: DataFrame, many: Column, week: Column, keep: list[str]) -> DataFrame:
    """Rows that match ``many`` become one row for each week with their number; others stay."""
    tagged = df.withColumn("week", week).withColumn("_m", many)
    kept = tagged.where(~F.coalesce("_m", F.lit(False))).select("week", *keep, F.lit(1).cast("long").alias("n"))
    return kept.unionByName(tagged.where("_m").groupBy("week", *keep[1:]).agg(F.min(keep[0]).alias(keep[0]), F.count(F.lit(1)).alias("n")))


def freshness(df: DataFrame, by: str, ts: str, as_of: Column, limits: DataFrame) -> DataFrame:
    """Newest row, number of rows, days since and whether that is beyond the source's limit."""
    seen = df.groupBy(by).agg(F.max(ts).alias("newest"), F.count(F.lit(1)).alias("n")).withColumn("age", F.datediff(as_of, F.to_date("newest")))
    return seen.join(limits, by, "left").select(by, "newest", "n", "age", (F.col("age") > F.coalesce("max_age", F.lit(7))).alias("stale"))


def level_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("yr", "level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("wk").alias("weeks"))
