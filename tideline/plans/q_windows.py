"""Queries of window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import ranks
from tideline.operators import windows as wi
from tideline.plans.catalog import query
from tideline.plans.q_aggregates import r6

SM = "(SELECT * FROM v_obs WHERE ev = 'singles' AND dr = 'main' AND cut IS NOT NULL)"


def sm(t):
    return t.v_obs.where("ev = 'singles' and dr = 'main' and cut is not null")


@query("e01_dedupe_latest", "SELECT ed_id FROM (SELECT ed_id, row_number() OVER (PARTITION BY n.country, e.yr, e.wk ORDER BY e.start_date DESC NULLS LAST, ed_id) AS rn FROM v_ed e JOIN v_ent n ON n.ent = e.ent) WHERE rn = 1")
def e01(t):
    return wi.dedupe_latest(t.v_ed.join(t.v_ent, "ent"), ["country", "yr", "wk"], "start_date", "ed_id").select("ed_id")


@query("e02_latest_per_key", "SELECT ent, ev, dr, ed_id, cut FROM (SELECT *, row_number() OVER (PARTITION BY ent, ev, dr ORDER BY yr DESC, ed_id) AS rn FROM v_obs WHERE cut IS NOT NULL) WHERE rn = 1")
def e02(t):
    return wi.latest_per_key(t.v_obs.where("cut is not null"), ["ent", "ev", "dr"], [F.col("yr").desc(), F.col("ed_id")]).select("ent", "ev", "dr", "ed_id", "cut")


@query("e04_yoy_flags", "SELECT ed_id, level IS NOT DISTINCT FROM lead(level) OVER w AS same_level, wk IS NOT DISTINCT FROM lead(wk) OVER w AS same_wk, lead(yr) OVER w AS older FROM v_ed WINDOW w AS (PARTITION BY ent ORDER BY yr DESC)")
def e04(t):
    return wi.yoy_flags(t.v_ed, "ent", "yr", ["level", "wk"]).select("ed_id", "same_level", "same_wk", "older")


@query("e05_cohort_score", f"WITH s AS {SM}, c AS (SELECT level, cut, count(*) AS k FROM s GROUP BY 1, 2) SELECT s.ed_id, round(100 * (sum(CASE WHEN c.cut > s.cut THEN k ELSE 0 END) + sum(CASE WHEN c.cut = s.cut THEN k ELSE 0 END) / 2) / sum(k), 6) AS score FROM s JOIN c ON c.level = s.level GROUP BY s.ed_id")
def e05(t):
    return r6(ranks.cohort_score(sm(t), "level", "cut").select("ed_id", "score"), "score")


@query("e06_requeue", "SELECT ed_id, CASE WHEN price > 100000 THEN sum(CASE WHEN price > 100000 THEN 1 ELSE 0 END) OVER (PARTITION BY yr, wk ORDER BY start_date, ed_id ROWS UNBOUNDED PRECEDING) END::BIGINT AS queue FROM v_ed")
def e06(t):
    return wi.requeue(t.v_ed, ["yr", "wk"], F.col("price") > 100000, ["start_date", "ed_id"]).select("ed_id", "queue")


@query("e07_prior_history", f"WITH s AS {SM} SELECT a.ed_id, cast(count(b.cut) AS INTEGER) AS prior_n, median(b.cut) AS prior_median FROM s a LEFT JOIN s b ON a.ent = b.ent AND b.yr < a.yr - 1 GROUP BY a.ed_id")
def e07(t):
    return wi.prior_history(sm(t), ["ent"], "yr", "cut").select("ed_id", "prior_n", "prior_median")


@query("e08_visible_pairs", f"WITH s AS {SM} SELECT a.ed_id, count(*) AS n, median(b.cut) AS med FROM s a JOIN s b ON a.yr = b.yr AND a.level = b.level AND a.country = b.country AND b.wk < a.wk - 2 GROUP BY a.ed_id")
def e08(t):
    on = ["yr", "level", "country"]
    asked = sm(t).select("ed_id", *on, (F.col("wk") - 2).alias("wk"))
    return asked.join(ranks.prefix_medians(sm(t), asked, on, "wk", "cut"), [*on, "wk"]).select("ed_id", "n", F.col("median").alias("med"))


#: A player's name for each cut: the same one may come back a year later, or another with the same rank.
NAMED_CUTS = "(SELECT ed_id, ent, ev, dr, yr, cut // 50 AS lv, concat('p', (ent + ed_id % 2) % 5) AS name FROM v_obs)"


@query("e09_repeated_value", f"SELECT ed_id, ev, dr, lv, name FROM (SELECT *, lag(lv) OVER w AS plv, lag(name) OVER w AS pname, lag(yr) OVER w AS pyr FROM {NAMED_CUTS} WINDOW w AS (PARTITION BY ent, ev, dr ORDER BY yr)) WHERE pyr = yr - 1 AND plv = lv AND pname = name")
def e09(t):
    o = t.v_obs.withColumn("lv", F.floor(F.col("cut") / 50).cast("int")).withColumn("name", F.concat(F.lit("p"), ((F.col("ent") + F.col("ed_id") % 2) % 5).cast("string")))
    return wi.repeated_value(o, ["ent", "ev", "dr"], "yr", ["lv", "name"]).select("ed_id", "ev", "dr", "lv", "name")


@query("e10_history_outlier", f"WITH s AS {SM}, h AS (SELECT a.ed_id, a.cut, count(b.cut) AS n, median(b.cut) AS m FROM s a JOIN s b ON a.ent = b.ent AND b.yr < a.yr GROUP BY 1, 2) SELECT ed_id, cut, m AS prior_median FROM h WHERE n >= 2 AND (cut > 2.5 * m OR cut < m / 2.5)")
def e10(t):
    return wi.history_outlier(sm(t), ["ent"], "yr", "cut").select("ed_id", "cut", "prior_median")


@query("e11_changed_since_last", "SELECT ed_id, level, last_known FROM (SELECT ed_id, level, lag(level) OVER (PARTITION BY ent ORDER BY yr) AS last_known FROM v_ed) WHERE last_known <> level")
def e11(t):
    return wi.changed_since_last(t.v_ed, "ent", "yr", "level").select("ed_id", "level", "last_known")


@query("e12_latest_two", "SELECT player, newest, previous FROM (SELECT player, kind AS newest, lead(kind) OVER w AS previous, row_number() OVER w AS rn FROM v_moves WINDOW w AS (PARTITION BY player ORDER BY ts DESC, seq DESC)) WHERE rn = 1")
def e12(t):
    return wi.latest_two(t.v_moves, ["player"], [F.col("ts").desc(), F.col("seq").desc()], "kind")


@query("e13_series", "SELECT ent, ev, dr, string_agg(concat(cast(yr AS VARCHAR), '=', cast(cut AS VARCHAR)), ';' ORDER BY yr) AS series FROM v_obs WHERE cut IS NOT NULL GROUP BY ent, ev, dr")
def e13(t):
    return wi.series(t.v_obs.where("cut is not null"), ["ent", "ev", "dr"], "yr", "cut")


@query("e14_top_contributors", "SELECT o_custkey, o_orderkey, place, n_of FROM (SELECT o_custkey, o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place, count(*) OVER (PARTITION BY o_custkey) AS n_of FROM orders) WHERE place <= 3")
def e14(t):
    return wi.top_contributors(t.orders, "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "place", F.col("of").alias("n_of"))
