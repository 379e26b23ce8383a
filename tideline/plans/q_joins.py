"""Queries of joins, set operations, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators import joins, sets, sorting
from tideline.plans.catalog import query
from tideline.plans.q_expressions import HAV


@query("a01_scan", "SELECT ed_id, ent, level FROM v_ed WHERE yr = 1996 AND level = 'ATP 500'")
def a01(t):
    return t.v_ed.where("yr = 1996 and level = 'ATP 500'").select("ed_id", "ent", "level")


@query("c01_star", "SELECT e.ed_id, n.country, s.ev, s.dr, s.direct_rank FROM v_ed e JOIN v_ent n ON n.ent = e.ent JOIN v_snap s ON s.ed_id = e.ed_id")
def c01(t):
    return joins.star(t.v_ed, t.v_ent, t.v_snap).select("ed_id", "country", "ev", "dr", "direct_rank")


@query("c02_prior_season", "SELECT a.ed_id, a.ev, a.dr, a.cut, b.cut AS prev FROM v_obs a LEFT JOIN v_obs b ON a.ent = b.ent AND a.ev = b.ev AND a.dr = b.dr AND b.yr = a.yr - 1")
def c02(t):
    return joins.prior_period(t.v_obs, ["ent", "ev", "dr"], "yr", "cut", "prev").select("ed_id", "ev", "dr", "cut", "prev")


@query("c03_semi_anti", "SELECT ed_id, 'has' AS kind FROM v_ed e WHERE EXISTS (SELECT 1 FROM v_snap s WHERE s.ed_id = e.ed_id AND s.adv_rank IS NOT NULL) UNION ALL SELECT ed_id, 'none' FROM v_ed e WHERE NOT EXISTS (SELECT 1 FROM v_snap s WHERE s.ed_id = e.ed_id AND s.alt_rank IS NOT NULL)")
def c03(t):
    s = t.v_snap
    has = joins.exists_any(t.v_ed, s.where("adv_rank is not null"), ["ed_id"])
    return sets.union_tagged({"has": has.select("ed_id"), "none": joins.exists_any(t.v_ed, s.where("alt_rank is not null"), ["ed_id"], anti=True).select("ed_id")}, "kind")


#: Orders that a later one of the same customer and year supersedes: rows to be matched to the editions.
GEN = "(SELECT o_orderkey AS gid, o_custkey AS ent, cast(o_orderdate AS DATE) AS gd, cast(year(o_orderdate) AS INTEGER) AS yr FROM orders WHERE o_orderkey NOT IN (SELECT ed_id FROM v_ed))"
DAYS = "abs(gd - start_date)"


def generics(t):
    every = t.orders.select(F.col("o_orderkey").alias("gid"), F.col("o_custkey").alias("ent"), F.col("o_orderdate").cast("date").alias("gd"), F.year("o_orderdate").alias("yr"))
    return every.join(t.v_ed.select(F.col("ed_id").alias("gid")), "gid", "left_anti")


#: Strict and base keys of the three fields and whether any has a digit.
_K = r"regexp_replace(regexp_replace(lower({c}), '\s+ch(\s+\d+)?$', ''), '[^a-z0-9]+', '', 'g') AS s_{c}, regexp_replace(regexp_replace(regexp_replace(lower({c}), '\s+ch(\s+\d+)?$', ''), '[^a-z0-9]+', '', 'g'), '[0-9]+$', '') AS b_{c}"
_KEYS = ", ".join(_K.format(c=c) for c in ("slug", "name", "city"))
_IN = "(length(g.b_{c}) >= 5 AND length(x.b_{c}) >= 5 AND (contains(g.b_{c}, x.b_{c}) OR contains(x.b_{c}, g.b_{c})))"
NAMED = rf"""gk AS (SELECT *, regexp_matches(concat(slug, name), '[0-9]') AS named, regexp_matches(concat(slug, name, city), '[0-9]') AS digits, {_KEYS} FROM v_generic WHERE level = 'Challenger'),
xk AS (SELECT *, regexp_matches(concat(slug, name), '[0-9]') AS named, regexp_matches(concat(slug, name, city), '[0-9]') AS digits, {_KEYS} FROM v_named WHERE status = 'held' AND regexp_matches(lower(level), '^challenger\s+(50|75|100|125|175)$'))"""
PAIRS_OF = "FROM gk g JOIN xk x ON x.yr = g.yr AND x.ed_id <> g.ed_id AND x.start_date BETWEEN g.start_date - 120 AND g.start_date + 120"
RUNG = f"""CASE WHEN abs(x.start_date - g.start_date) <= 7 AND x.s_slug = g.s_slug THEN 100 WHEN abs(x.start_date - g.start_date) <= 7 AND x.s_name = g.s_name THEN 95
 WHEN abs(x.start_date - g.start_date) <= 7 AND x.s_city = g.s_city AND NOT x.digits AND NOT g.digits THEN 90 WHEN x.digits OR g.digits THEN NULL WHEN x.b_slug = g.b_slug THEN 80 WHEN x.b_name = g.b_name THEN 78 WHEN x.b_city = g.b_city THEN 76
 WHEN {_IN.format(c='slug')} THEN 70 WHEN {_IN.format(c='name')} THEN 68 WHEN {_IN.format(c='city')} THEN 66 END"""
LADDER = f"{NAMED}, sc AS (SELECT g.ed_id AS gid, x.ed_id AS xid, abs(x.start_date - g.start_date) AS days, x.name AS x_name, x.level AS x_level, {RUNG} AS score {PAIRS_OF})"
OVERLAY = f"""{NAMED}, best AS (SELECT g.ed_id AS gid, x.ed_id AS xid, x.start_date AS x_start_date, x.level AS x_level {PAIRS_OF}
 WHERE (abs(x.start_date - g.start_date) <= 7 AND (x.s_slug = g.s_slug OR x.s_name = g.s_name OR x.s_city = g.s_city))
  OR (NOT g.named AND NOT x.named AND (x.b_slug = g.b_slug OR x.b_name = g.b_name OR x.b_city = g.b_city OR {_IN.format(c='slug')} OR {_IN.format(c='name')} OR {_IN.format(c='city')}))
 QUALIFY row_number() OVER (PARTITION BY g.ed_id ORDER BY CASE WHEN x.s_slug = g.s_slug THEN 0 WHEN x.s_name = g.s_name THEN 1 WHEN x.s_city = g.s_city THEN 2 WHEN x.b_slug = g.b_slug THEN 3 WHEN x.b_name = g.b_name THEN 4 WHEN x.b_city = g.b_city THEN 5 ELSE 6 END, abs(x.start_date - g.start_date), x.updated DESC NULLS LAST, x.ed_id) = 1)"""


@query("c04_best_match", f"WITH {OVERLAY} SELECT gid, xid AS ed_id, x_level AS level FROM best")
def c04(t):
    return joins.ladder_match(t.v_generic, t.v_named, by_score=False).select("gid", F.col("x_ed_id").alias("ed_id"), F.col("x_level").alias("level"))


@query("c05_scored_match", f"WITH {LADDER} SELECT gid, xid AS ed_id, score FROM sc WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY gid ORDER BY score DESC, days, x_name, xid) = 1")
def c05s(t):
    return joins.ladder_match(t.v_generic, t.v_named).select("gid", F.col("x_ed_id").alias("ed_id"), "score")


@query("c05_e03_mutual_best", f"WITH {LADDER}, a AS (SELECT *, row_number() OVER (PARTITION BY xid ORDER BY score DESC, days, gid) AS r1 FROM sc WHERE score IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY score DESC, days, xid) AS r2 FROM a WHERE r1 = 1) SELECT gid, xid, score FROM b WHERE r2 = 1")
def c05(t):
    return joins.mutual_ladder(t.v_generic, t.v_named)


@query("c06_nearest_date", f"SELECT gid, ed_id, delta, others FROM (SELECT gid, ed_id, cast(abs(gd - start_date) AS INTEGER) AS delta, count(*) OVER (PARTITION BY gid) - 1 AS others, row_number() OVER (PARTITION BY gid ORDER BY abs(gd - start_date), ed_id) AS rn FROM {GEN} g JOIN v_ed e ON g.ent = e.ent WHERE abs(gd - start_date) <= 200) WHERE rn = 1")
def c06(t):
    ed = t.v_ed.select("ed_id", "ent", "start_date")
    return joins.nearest_within(generics(t), ed, ["ent"], "gid", "ed_id", F.abs(F.datediff("gd", "start_date")), 200).select("gid", "ed_id", "delta", "others")


@query("c07_prior_reference", "SELECT ed_id, ref_id, ref_cut FROM (SELECT a.ed_id, b.ed_id AS ref_id, b.cut AS ref_cut, row_number() OVER (PARTITION BY a.ed_id ORDER BY abs(b.wk - a.wk), b.yr DESC, b.ed_id) AS rn FROM v_obs a JOIN v_obs b ON a.country = b.country AND a.level = b.level AND b.yr < a.yr AND abs(b.wk - a.wk) <= 2 AND b.cut IS NOT NULL AND a.ev = 'singles' AND a.dr = 'main' AND b.ev = 'singles' AND b.dr = 'main') WHERE rn = 1")
def c07(t):
    o = t.v_obs.where("ev = 'singles' and dr = 'main'")
    refs = o.select("country", "level", F.col("ed_id").alias("ref_id"), F.col("yr").alias("ref_yr"), F.col("wk").alias("ref_wk"), F.col("cut").alias("ref_cut"))
    return joins.prior_reference(o, refs, ["country", "level"], "ed_id").select("ed_id", "ref_id", "ref_cut")


@query("c08_as_of", "SELECT ed_id, snap_date, rk FROM v_ed e ASOF LEFT JOIN (SELECT o_custkey AS ent, cast(o_orderdate AS DATE) AS snap_date, max(o_totalprice) AS rk FROM orders GROUP BY ALL) r ON e.ent = r.ent AND e.start_date >= r.snap_date")
def c08(t):
    r = t.orders.groupBy(F.col("o_custkey").alias("ent"), F.col("o_orderdate").cast("date").alias("snap_date")).agg(F.max("o_totalprice").alias("rk"))
    return joins.as_of(t.v_ed, r, ["ent"], "start_date", "snap_date", ["rk"]).select("ed_id", F.col("asof_snap_date").alias("snap_date"), F.col("asof_rk").alias("rk"))


PLACED = "(SELECT ed_id, yr, wk, level, n.ent, lat, lon FROM v_ed e JOIN v_ent n ON n.ent = e.ent)"


@query("c09_near_in_time_space", f"SELECT a.ed_id, b.ed_id AS other, round({HAV.format(a='a', b='b')}, 6) AS km FROM {PLACED} a JOIN {PLACED} b ON a.yr = b.yr AND abs(a.wk - b.wk) <= 1 AND a.ed_id <> b.ed_id WHERE {HAV.format(a='a', b='b')} <= 800")
def c09(t):
    p = t.v_ed.join(t.v_ent, "ent").select("ed_id", "yr", "wk", "level", "ent", "lat", "lon")
    return joins.near_in_time_space(p, p, ["yr"], "wk", [-1, 0, 1], 800).where("ed_id <> r_ed_id").select("ed_id", F.col("r_ed_id").alias("other"), F.round("km", 6).alias("km"))


@query("c10_span_scope", "SELECT ed_id, cast(wk + k AS INTEGER) AS at_wk FROM v_ed, range(0, 3) r(k) WHERE k < CASE WHEN level = 'ATP 500' THEN 3 ELSE 1 END")
def c10(t):
    e = t.v_ed.withColumn("span", F.when(F.col("level") == "ATP 500", 3).otherwise(1))
    return joins.span_scope(e, "wk", "span", "at_wk").select("ed_id", "at_wk")


CHAIN = "(SELECT ed_id, yr, wk, country, region, surface, lat, lon FROM v_ed e JOIN v_ent n ON n.ent = e.ent)"
PAIRS = "(SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND abs(a.n_nationkey - b.n_nationkey) = 5)"


def chain_events(t):
    return t.v_ed.join(t.v_ent, "ent").select("ed_id", "yr", "wk", "country", "region", "surface", "lat", "lon")


def country_pairs(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.abs(F.col("a.n_nationkey") - F.col("b.n_nationkey")) == 5)).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


EDGES = f"SELECT a.ed_id AS src, b.ed_id AS dst FROM {CHAIN} a JOIN {CHAIN} b ON a.yr = b.yr AND a.wk + 1 = b.wk AND a.surface = b.surface AND a.region = b.region WHERE a.country = b.country OR (EXISTS (SELECT 1 FROM {PAIRS} p WHERE p.a = a.country AND p.b = b.country) AND {HAV.format(a='a', b='b')} <= 600)"


@query("c11_adjacency", EDGES)
def c11(t):
    return joins.adjacency_edges(chain_events(t), country_pairs(t))


POINTS = "(SELECT s_suppkey AS point, cast(s_suppkey * 37 % 120 - 60 AS DOUBLE) AS p_lat, cast(s_suppkey * 53 % 360 - 180 AS DOUBLE) AS p_lon FROM supplier)"


#: Cities whose point is known: the first of their country.
KNOWN = "(SELECT concat(n_name, ' 3') AS city, min(s_suppkey) AS point FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)"


@query("c12_nearest_point", f"WITH o AS {KNOWN} SELECT ent, point, round(km, 6) AS km FROM (SELECT n.ent, p.point, {HAV.format(a='n', b='p').replace('p.lat', 'p.p_lat').replace('p.lon', 'p.p_lon')} AS km, row_number() OVER (PARTITION BY n.ent ORDER BY {HAV.format(a='n', b='p').replace('p.lat', 'p.p_lat').replace('p.lon', 'p.p_lon')}, p.point) AS rn FROM v_ent n, {POINTS} p WHERE n.city NOT IN (SELECT city FROM o)) WHERE rn = 1 AND km < 400 UNION ALL SELECT ent, point, NULL FROM v_ent JOIN o USING (city)")
def c12(t):
    k = F.col("s_suppkey")
    pts = t.supplier.select(k.alias("point"), (k * 37 % 120 - 60).cast("double").alias("p_lat"), (k * 53 % 360 - 180).cast("double").alias("p_lon"))
    known = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.concat("n_name", F.lit(" 3")).alias("city")).agg(F.min(k).alias("point"))
    return joins.nearest_point(t.v_ent, pts, "ent", 400, overrides=known).select("ent", "point", F.round("km", 6).alias("km"))


#: Short names: the first two or three words of a part's name, in another order; one part in nine has a single word.
SHORT = "(SELECT p_partkey AS a, CASE WHEN p_partkey % 9 = 0 THEN string_split(p_name, ' ')[1:1] WHEN p_partkey % 2 = 0 THEN list_reverse(string_split(p_name, ' ')[1:2]) ELSE string_split(p_name, ' ')[2:4] END AS x FROM part)"


@query("c13_token_match", f"WITH s AS (SELECT a, list_distinct(x) AS x FROM {SHORT}), p AS (SELECT p_partkey AS b, list_distinct(string_split(p_name, ' ')) AS y FROM part), m AS (SELECT *, len(list_intersect(x, y)) AS n FROM s, p) SELECT a, b FROM m WHERE n = least(len(x), len(y)) AND (n >= 2 OR (len(x) = 1 AND len(y) = 1 AND n = 1))")
def c13(t):
    parts = F.split("p_name", " ")
    k = F.col("p_partkey")
    short = F.when(k % 9 == 0, F.slice(parts, 1, 1)).when(k % 2 == 0, F.reverse(F.slice(parts, 1, 2))).otherwise(F.slice(parts, 2, 3))
    s = t.part.select(k.alias("a"), F.array_join(short, " ").alias("name"))
    return joins.token_match(s, t.part.select(k.alias("b"), F.col("p_name").alias("name")), "name", "name").select("a", F.col("r_b").alias("b"))


@query("c14_g02_union_codes", "SELECT key, code, array_to_string(list_sort(list(DISTINCT src)), ',') AS sources FROM (SELECT o_custkey AS key, o_orderstatus AS code, 0 AS src FROM orders UNION ALL SELECT o_custkey, substring(o_orderpriority, 1, 1), 1 FROM orders UNION ALL SELECT c_custkey, substring(c_mktsegment, 1, 1), 2 FROM customer) GROUP BY key, code")
def c14(t):
    return joins.union_codes(t.orders.select("o_custkey", "o_orderstatus"), t.orders.select("o_custkey", F.substring("o_orderpriority", 1, 1)), t.customer.select("c_custkey", F.substring("c_mktsegment", 1, 1)))


@query("c15_match_names", "WITH p AS (SELECT lower(concat(n_name, cast(c_custkey % 50 AS VARCHAR))) AS name_key, c_custkey AS player FROM customer JOIN nation ON c_nationkey = n_nationkey ), ids AS (SELECT name_key, count(*) AS n, min(player) AS player FROM p GROUP BY 1) SELECT c_custkey AS ent, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN n = 1 THEN player END AS player FROM (SELECT c_custkey, lower(concat(n_name, cast(c_custkey % 50 AS VARCHAR))) AS name_key FROM customer JOIN nation ON c_nationkey = n_nationkey) e LEFT JOIN ids USING (name_key)")
def c15(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower(F.concat("n_name", (F.col("c_custkey") % 50).cast("string"))).alias("name_key"))
    return joins.match_names(c.withColumnRenamed("c_custkey", "ent"), c.withColumnRenamed("c_custkey", "player")).select("ent", "status", "player")


@query("c16_fan_out", "SELECT s.c_custkey, e.ed_id FROM (SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['ATP 500', 'ITF M25'] ELSE ['Challenger 75'] END) AS level FROM customer) s JOIN v_ed e ON e.level = s.level AND e.yr = 1997 AND e.wk = 20 AND e.ent % 20 = s.c_custkey % 20")
def c16(t):
    wants = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("ATP 500"), F.lit("ITF M25"))).otherwise(F.array(F.lit("Challenger 75")))
    subs = t.customer.select("c_custkey", (F.col("c_custkey") % 20).alias("circle"), wants.alias("levels"))
    items = t.v_ed.where("yr = 1997 and wk = 20").withColumn("circle", F.col("ent") % 20)
    return joins.fan_out(subs, items, "levels", ["level", "circle"]).select("c_custkey", "ed_id")


@query("c17_lookup", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def c17(t):
    return t.lineitem.where("l_quantity > 45").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("f01_f06_priority_order", "SELECT ed_id, pos FROM (SELECT ed_id, row_number() OVER (ORDER BY CASE level WHEN 'ATP 500' THEN 80 WHEN 'ATP 250' THEN 70 WHEN 'Challenger 125' THEN 55 WHEN 'Challenger 75' THEN 45 ELSE 20 END DESC, price DESC, ed_id) AS pos FROM v_ed) WHERE pos <= 50")
def f01(t):
    return sorting.prestige_top(t.v_ed, 50).select("ed_id", "pos")


@query("f02_worst_misses", "SELECT ed_id, miss FROM (SELECT a.ed_id, abs(a.cut - b.cut) AS miss FROM v_obs a JOIN v_obs b ON a.ent = b.ent AND a.ev = b.ev AND a.dr = b.dr AND b.yr = a.yr - 1 WHERE a.ev = 'singles' AND a.dr = 'main' AND a.cut IS NOT NULL AND b.cut IS NOT NULL) ORDER BY miss DESC, ed_id LIMIT 25")
def f02(t):
    o = joins.prior_period(t.v_obs.where("ev = 'singles' and dr = 'main'"), ["ent"], "yr", "cut", "prev").where("cut is not null and prev is not null")
    return sorting.top_n(o.select("ed_id", F.abs(F.col("cut") - F.col("prev")).alias("miss")), [F.col("miss").desc(), F.col("ed_id")], 25)


@query("f03_j34_candidates", f"""WITH a AS (SELECT * FROM v_ent WHERE ent = 7), x AS (SELECT e.ed_id, e.wk, {HAV.format(a='a', b='n')} AS km,
 CASE WHEN n.city = a.city AND n.country = a.country THEN 0 WHEN n.country = a.country THEN 1 WHEN EXISTS (SELECT 1 FROM {PAIRS} p WHERE p.a = a.country AND p.b = n.country) THEN 2 WHEN n.region = a.region THEN 3 WHEN {HAV.format(a='a', b='n')} <= 1500 THEN 4 END AS tier
 FROM v_ed e JOIN v_ent n ON n.ent = e.ent CROSS JOIN a WHERE e.yr = 1997 AND abs(e.wk - 20) <= 3 AND n.ent <> 7)
SELECT ed_id, tier, cast(abs(wk - 20) AS INTEGER) AS gap, round(km, 3) AS km FROM x WHERE tier IS NOT NULL ORDER BY tier, gap, km, ed_id LIMIT 100""")
def f03(t):
    events = t.v_ed.where("yr = 1997").join(t.v_ent, "ent")
    return sorting.candidates(events, t.v_ent.where("ent = 7"), country_pairs(t), 20, 3, 100)


@query("f04_paging", "SELECT o_orderkey, pos, total - pos > 0 AS more FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos, count(*) OVER () AS total FROM orders) WHERE pos BETWEEN 101 AND 150")
def f04(t):
    return sorting.page(t.orders, [F.col("o_orderdate"), F.col("o_orderkey")], 100, 50).select("o_orderkey", "pos", "more")


@query("f05_seeded_sample")
def f05(t):
    return sorting.seeded_sample(t.v_ed, "ed_id", F.col("yr") >= 2000, 40, 20240601).select("ed_id", "recent")


@query("g03_snapshot_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'appeared' WHEN b.k IS NULL THEN 'disappeared' ELSE 'changed' END AS change FROM (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def g03(t):
    at = lambda y: t.orders.where(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return sets.snapshot_diff(at(1996), at(1997), ["k"], ["v"]).select("k", "change")


@query("g05_scopes", "SELECT DISTINCT e.yr, s.scope, count(*) AS n FROM (SELECT yr, CASE WHEN level LIKE 'ATP%' THEN 'atp' WHEN level LIKE 'Ch%' THEN 'challenger' ELSE 'itf' END AS g FROM v_ed) e JOIN (VALUES ('atp', 'atp'), ('challenger', 'challenger'), ('itf', 'itf'), ('atp+challenger', 'atp'), ('atp+challenger', 'challenger'), ('atp+itf', 'atp'), ('atp+itf', 'itf'), ('challenger+itf', 'challenger'), ('challenger+itf', 'itf'), ('atp+challenger+itf', 'atp'), ('atp+challenger+itf', 'challenger'), ('atp+challenger+itf', 'itf')) AS s(scope, g) ON s.g = e.g GROUP BY e.yr, s.scope")
def g05(t):
    from tideline.functions import levels

    return sets.scope_fanout(t.v_ed.withColumn("grp", levels.level_group(F.col("level"))), "grp", ["atp", "challenger", "itf"]).groupBy("yr", "scope").agg(F.count(F.lit(1)).alias("n"))
