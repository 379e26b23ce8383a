"""Queries of aggregates and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import levels
from tideline.operators import aggregates as ag
from tideline.operators import joins
from tideline.plans.catalog import query


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


YOY = "(SELECT a.ed_id, a.ent, a.yr, a.wk, a.level, a.country, a.ev, a.dr, a.cut, b.cut AS prev FROM v_obs a JOIN v_obs b ON a.ent = b.ent AND a.ev = b.ev AND a.dr = b.dr AND b.yr = a.yr - 1 WHERE a.cut IS NOT NULL AND b.cut IS NOT NULL)"


def yoy(t):
    return joins.prior_period(t.v_obs, ["ent", "ev", "dr"], "yr", "cut", "prev").where("cut is not null and prev is not null")


@query("d01_pivot", "SELECT ed_id, max(direct_rank) FILTER (WHERE ev = 'singles' AND dr = 'main') AS ms, max(direct_rank) FILTER (WHERE ev = 'singles' AND dr = 'qualifying') AS qs, max(direct_rank) FILTER (WHERE ev = 'doubles') AS md, cast(count(direct_rank) AS INTEGER) AS n, bool_or(direct_rank IS NULL) AS gap FROM v_snap GROUP BY ed_id")
def d01(t):
    return ag.pivot_facts(t.v_snap, "ed_id", "direct_rank")


@query("d02_coverage", "SELECT ed_id, CASE WHEN count(alt_rank) = 0 THEN 'missing' WHEN count(alt_rank) < count(*) THEN 'null' ELSE 'with' END AS coverage FROM v_snap GROUP BY ed_id")
def d02(t):
    return ag.coverage_flags(t.v_snap, "ed_id", "alt_rank")


@query("d03_summary_stats", f"SELECT level, dr, count(cut) AS n, median(cut) AS median, round(avg(cut), 6) AS mean, round(stddev_samp(cut), 6) AS sd, round(avg(abs(cut - prev)), 6) AS mae FROM {YOY} GROUP BY level, dr")
def d03(t):
    return r6(ag.summary_stats(yoy(t), ["level", "dr"], "cut", "prev"), "mean", "sd", "mae")


@query("d04_nearest_quantiles", f"SELECT level, max(e) FILTER (WHERE i = least(n - 1, cast(floor(n * 0.5e0) AS BIGINT))) AS p50, max(e) FILTER (WHERE i = least(n - 1, cast(floor(n * 0.75e0) AS BIGINT))) AS p75, max(e) FILTER (WHERE i = least(n - 1, cast(floor(n * 0.9e0) AS BIGINT))) AS p90 FROM (SELECT level, abs(cut - prev) AS e, row_number() OVER (PARTITION BY level ORDER BY abs(cut - prev)) - 1 AS i, count(*) OVER (PARTITION BY level) AS n FROM {YOY}) GROUP BY level")
def d04(t):
    return ag.nearest_quantiles(yoy(t).withColumn("e", F.abs(F.col("cut") - F.col("prev"))), ["level"], "e", {"p50": 0.5, "p75": 0.75, "p90": 0.9})


@query("d05_correlation", f"""WITH y AS {YOY}, k AS (SELECT level, cut, prev, rank() OVER (PARTITION BY level ORDER BY cut) + (count(*) OVER (PARTITION BY level, cut) - 1) / 2 AS rx, rank() OVER (PARTITION BY level ORDER BY prev) + (count(*) OVER (PARTITION BY level, prev) - 1) / 2 AS ry FROM y)
SELECT level, 'pearson' AS method, count(*) AS n, round(corr(cut, prev), 6) AS r FROM k GROUP BY level UNION ALL SELECT level, 'spearman', count(*), round(corr(rx, ry), 6) FROM k GROUP BY level""")
def d05(t):
    y = yoy(t)
    parts = [r6(ag.correlation(y, ["level"], "cut", "prev", m), "r").withColumn("method", F.lit(m)) for m in ("pearson", "spearman")]
    return parts[0].unionByName(parts[1])


@query("d06_ols_origin", f"SELECT level, round(sum(cast(prev AS DOUBLE) * cut) / sum(cast(prev AS DOUBLE) * prev), 6) AS slope FROM {YOY} GROUP BY level")
def d06(t):
    return r6(ag.ols_origin(yoy(t).withColumn("x", F.col("prev").cast("double")), ["level"], "x", "cut"), "slope")


@query("d07_leave_one_out", f"WITH y AS {YOY}, s AS (SELECT yr, count(*) AS n, sum(cast(prev AS DOUBLE) * prev) AS xx, sum(cast(prev AS DOUBLE) * cut) AS xy FROM y GROUP BY yr), f AS (SELECT yr, sum(n) OVER () - n AS train_n, (sum(xy) OVER () - xy) / (sum(xx) OVER () - xx) AS slope FROM s) SELECT f.yr, cast(train_n AS BIGINT) AS train_n, round(slope, 6) AS slope, round(avg(abs(cut - slope * prev)), 6) AS mae FROM y JOIN f ON y.yr = f.yr GROUP BY f.yr, train_n, slope")
def d07(t):
    return r6(ag.leave_one_out(yoy(t).withColumn("x", F.col("prev").cast("double")), "yr", "x", "cut"), "slope", "mae")


@query("d08_concordance", f"WITH y AS (SELECT * FROM {YOY} WHERE ev = 'singles' AND dr = 'main'), p AS (SELECT a.yr, a.wk, sign(a.cut - b.cut) * sign(a.prev - b.prev) AS s FROM y a JOIN y b ON a.yr = b.yr AND a.wk = b.wk AND a.ed_id < b.ed_id) SELECT yr, wk, count(*) AS pairs, round(avg(CASE WHEN s > 0 THEN 1 ELSE 0 END), 6) AS rate FROM p WHERE s <> 0 GROUP BY yr, wk")
def d08(t):
    return r6(ag.concordance(yoy(t).where("ev = 'singles' and dr = 'main'"), ["yr", "wk"], "ed_id", "cut", "prev"), "rate")


@query("d09_binned", f"SELECT cast(floor(prev / 10) * 10 AS BIGINT) AS bin, count(*) AS n, median(cut) AS median, round(stddev_samp(cut), 6) AS sd FROM {YOY} GROUP BY 1 HAVING count(*) >= 5")
def d09(t):
    return r6(ag.binned(yoy(t), "prev", "cut", 10, 5), "sd")


@query("d09_binned_spread", f"WITH y AS {YOY}, b AS (SELECT dr, floor(prev / 10) AS bin, stddev_samp(cut) AS sd FROM y GROUP BY 1, 2 HAVING count(*) >= 5), t AS (SELECT dr, stddev_samp(cut) AS sd FROM y GROUP BY 1) SELECT b.dr, count(*) AS bins, round(avg(b.sd) / any_value(t.sd), 6) AS spread FROM b JOIN t ON t.dr = b.dr GROUP BY b.dr")
def d09s(t):
    return r6(ag.binned_spread(yoy(t), "prev", "cut", 10, 5, ["dr"]), "spread")


@query("d10_d11_slice_summary", f"SELECT dr, ev, level, cast(grouping_id(dr, ev, level) AS BIGINT) AS slice, count(*) AS n, round(avg(abs(prev - cut)), 6) AS mae, round(avg(abs(300 - cut)), 6) AS base_mae, round(avg(prev - cut), 6) AS bias, round(avg(CASE WHEN abs(prev - cut) < abs(300 - cut) THEN 1 WHEN abs(prev - cut) = abs(300 - cut) THEN 0.5 ELSE 0 END), 6) AS win_rate FROM {YOY} GROUP BY GROUPING SETS ((), (dr), (ev, dr), (level))")
def d10(t):
    y = yoy(t).withColumn("base", F.lit(300))
    return r6(ag.slice_summary(y, [[], ["dr"], ["dr", "ev"], ["level"]], ag.error_metrics("prev", "base", "cut")), "mae", "base_mae", "bias", "win_rate")


@query("d12_level_counts", "SELECT yr, level, count(*) AS n, count(DISTINCT wk) AS weeks FROM v_ed GROUP BY yr, level")
def d12(t):
    return ag.level_counts(t.v_ed)


@query("d13_value_drift", "SELECT ent, count(DISTINCT level) AS kinds, string_agg(concat(cast(yr AS VARCHAR), ':', level), ',' ORDER BY yr) AS history FROM v_ed GROUP BY ent HAVING count(DISTINCT level) > 1")
def d13(t):
    return ag.value_drift(t.v_ed, "ent", "yr", "level")


@query("d14_tier_mix", "WITH c AS (SELECT ent, level, count(*) AS n, CASE level WHEN 'ATP 500' THEN 80 WHEN 'ATP 250' THEN 70 WHEN 'Challenger 125' THEN 55 WHEN 'Challenger 75' THEN 45 ELSE 20 END AS r FROM v_ed GROUP BY ent, level) SELECT ent, string_agg(concat(cast(n AS VARCHAR), 'x ', level), ' + ' ORDER BY r DESC, level) AS mix FROM c GROUP BY ent")
def d14(t):
    return ag.tier_mix(t.v_ed, "ent", "level", levels.level_rank(F.col("level")))


@query("d15_route_tally", "SELECT list, coalesce(CASE WHEN player % 7 = 0 THEN 'WC' WHEN player % 7 = 1 THEN 'Q' END, 'DA') AS route, cast(sum(CASE WHEN kind <> 'withdrawal' THEN 1 ELSE 0 END) AS BIGINT) AS live, cast(sum(CASE WHEN kind = 'withdrawal' THEN 1 ELSE 0 END) AS BIGINT) AS departed FROM v_moves GROUP BY 1, 2")
def d15(t):
    route = F.coalesce(F.when(F.col("player") % 7 == 0, "WC").when(F.col("player") % 7 == 1, "Q"), F.lit("DA"))
    return ag.tally_routes(t.v_moves, ["list"], route, F.col("kind") != "withdrawal")


@query("d16_draw_sizes", "SELECT l_suppkey, max(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS main, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS qual FROM lineitem GROUP BY l_suppkey")
def d16(t):
    return ag.draw_sizes(t.lineitem, "l_suppkey", "l_quantity", "l_returnflag", "^R$")


@query("d17_ordered_collect", "SELECT ent, string_agg(cast(ed_id AS VARCHAR), ',' ORDER BY start_date, ed_id) AS ordered FROM v_ed GROUP BY ent")
def d17(t):
    return ag.ordered_collect(t.v_ed, "ent", F.struct("start_date", "ed_id"), "ed_id")


@query("d18_duplicate_groups", "SELECT o_custkey, cast(o_orderdate AS DATE) AS d, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def d18(t):
    return ag.duplicate_groups(t.orders.withColumn("d", F.col("o_orderdate").cast("date")), ["o_custkey", "d"], "o_orderkey")


@query("d19_climate", "WITH w AS (SELECT o_custkey % 10 AS place, cast(o_orderdate AS DATE) AS day, cast(floor(max(o_totalprice)) AS BIGINT) AS x FROM orders GROUP BY 1, 2), g AS (SELECT ed_id AS id, ent % 10 AS place, cast(start_date - to_years(cast(b AS INTEGER)) AS DATE) AS d0 FROM v_ed, range(1, 6) r(b) WHERE yr >= 2000) SELECT id, round(cast(sum(x) AS DOUBLE), 1) AS total_x, count(x) AS n FROM g JOIN w ON w.place = g.place AND w.day BETWEEN g.d0 AND g.d0 + 6 GROUP BY id")
def d19(t):
    daily = t.orders.groupBy((F.col("o_custkey") % 10).alias("place"), F.col("o_orderdate").cast("date").alias("day")).agg(F.floor(F.max("o_totalprice")).alias("x"))
    targets = t.v_ed.where("yr >= 2000").select(F.col("ed_id").alias("id"), (F.col("ent") % 10).alias("place"), F.col("start_date").alias("d"))
    return ag.climate(targets, daily).select("id", F.round(F.col("mean_x") * F.col("n"), 1).alias("total_x"), "n")


@query("d20_collapse_weekly", "SELECT cast(date_trunc('week', start_date) AS DATE) AS week, ed_id, level, cast(1 AS BIGINT) AS n FROM v_ed WHERE level NOT LIKE 'ITF%' UNION ALL SELECT cast(date_trunc('week', start_date) AS DATE), min(ed_id), level, count(*) FROM v_ed WHERE level LIKE 'ITF%' GROUP BY 1, 3")
def d20(t):
    return ag.collapse_weekly(t.v_ed, F.col("level").startswith("ITF"), F.date_trunc("week", "start_date").cast("date"), ["ed_id", "level"])


@query("d21_freshness", "SELECT event_type, max(ts) AS newest, count(*) AS n, cast(DATE '2024-02-05' - cast(max(ts) AS DATE) AS INTEGER) AS age, DATE '2024-02-05' - cast(max(ts) AS DATE) > CASE WHEN event_type = 'click' THEN 3 ELSE 7 END AS stale FROM events WHERE event_type <> 'view' OR ts < TIMESTAMP '2024-01-20' GROUP BY event_type")
def d21(t):
    limits = t.spark.createDataFrame([("click", 3)], "event_type string, max_age int")
    return ag.freshness(t.events.where("event_type <> 'view' or ts < timestamp '2024-01-20'"), "event_type", "ts", F.to_date(F.lit("2024-02-05")), limits)
