"""Queries of graphs, audits, the ledger and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import chains, merge, quality, sets
from tideline.plans.catalog import query
from tideline.plans.q_expressions import HAV, MINP
from tideline.plans.q_joins import CHAIN, EDGES, LADDER, PLACED, chain_events, country_pairs

REACH = "both_ AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), reach(node, root) AS (SELECT DISTINCT src, src FROM both_ UNION SELECT b.dst, r.root FROM reach r JOIN both_ b ON b.src = r.node), comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"


@query("k00_connected_components", f"WITH RECURSIVE e AS ({EDGES}), {REACH} SELECT node, component FROM comp")
def k00(t):
    return chains.chain_members(chain_events(t), country_pairs(t)).select(F.col("ed_id").alias("node"), F.col("chain").alias("component"))


@query("k01_chains", f"""WITH RECURSIVE e AS ({EDGES}), {REACH}, m AS (SELECT c.component AS chain, v.* FROM comp c JOIN {CHAIN} v ON v.ed_id = c.node),
f AS (SELECT chain, count(DISTINCT wk) AS weeks, count(DISTINCT concat(lat, '/', lon)) AS places FROM m GROUP BY chain HAVING count(DISTINCT wk) >= 2)
SELECT chain, ed_id, CASE WHEN places = 1 AND weeks > 3 THEN 'series' ELSE 'swing' END AS kind FROM m JOIN f USING (chain)""")
def k01(t):
    return chains.whole_chains(chain_events(t), country_pairs(t)).select("chain", "ed_id", "kind")


@query("k01_chain_parts")
def k01p(t):
    return chains.chains(chain_events(t), country_pairs(t), max_weeks=4)


@query("d22_chain_summary", f"""WITH RECURSIVE e AS ({EDGES}), {REACH}, m AS (SELECT c.component AS chain, v.* FROM comp c JOIN {CHAIN} v ON v.ed_id = c.node),
h AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM m WINDOW w AS (PARTITION BY chain ORDER BY wk, ed_id)), p AS (SELECT chain, wk, {HAV.format(a='h', b='g').replace('g.lat', 'h.la').replace('g.lon', 'h.lo')} AS km FROM h),
c AS (SELECT chain, country, min(wk * 1000000000::BIGINT + ed_id) AS k FROM m GROUP BY 1, 2), cc AS (SELECT chain, string_agg(country, ',' ORDER BY k) AS countries FROM c GROUP BY chain)
SELECT chain, cast(max(wk) - min(wk) + 1 AS INTEGER) AS weeks, count(*) AS stops, countries, round(max(km), 5) AS max_hop FROM p JOIN cc USING (chain) GROUP BY chain, countries""")
def d22(t):
    members = chains.chain_members(chain_events(t), country_pairs(t))
    return chains.chain_summary(members, ["chain"]).withColumn("max_hop", F.round("max_hop", 5))


@query("k02_cluster_within", f"WITH RECURSIVE e AS (SELECT a.ed_id AS src, b.ed_id AS dst FROM {PLACED} a JOIN {PLACED} b ON a.yr = b.yr AND a.wk = b.wk AND a.ed_id < b.ed_id WHERE {HAV.format(a='a', b='b')} <= 900), {REACH} SELECT v.ed_id, coalesce(component, v.ed_id) AS cluster FROM v_ed v LEFT JOIN comp ON node = v.ed_id")
def k02(t):
    return chains.cluster_within(t.v_ed.join(t.v_ent, "ent"), ["yr"], "wk", 900)


@query("k03_k04_splits", """WITH RECURSIVE r AS (SELECT n.city AS place, e.ent, e.yr, e.wk, e.level, CASE WHEN e.ent % 3 > 0 THEN cast(e.ent % 2 + 1 AS INTEGER) END AS num FROM v_ed e JOIN v_ent n ON n.ent = e.ent),
p AS (SELECT a.ent AS src, b.ent AS dst, bool_or(a.yr = b.yr AND a.wk = b.wk) AS same, bool_or(a.yr = b.yr) AS overlap, min(abs(a.wk - b.wk)) AS gap, bool_or(a.level = b.level) AS lv FROM r a JOIN r b ON a.place = b.place AND a.ent < b.ent WHERE a.num IS NULL OR b.num IS NULL OR a.num = b.num GROUP BY 1, 2), e AS (SELECT src, dst FROM p WHERE lv AND (same OR (NOT overlap AND gap <= 1))), """ + REACH + """,
f AS (SELECT node AS ent, component AS cluster, (SELECT count(cut) FROM v_obs o WHERE o.ent = node) AS cuts, (SELECT count(*) FROM v_ed d WHERE d.ent = node) AS editions, (SELECT length(slug) FROM v_ent n WHERE n.ent = node) AS len FROM comp)
SELECT cluster, ent AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cuts DESC, editions DESC, len DESC, ent) AS rn FROM f) WHERE rn = 1""")
def k03(t):
    number = F.when(F.col("ent") % 3 > 0, (F.col("ent") % 2 + 1).cast("int"))
    r = t.v_ed.join(t.v_ent, "ent").select(F.col("city").alias("place"), "ent", number.alias("number"), "yr", "wk", "level")
    facts = t.v_ent.select("ent", "slug").join(t.v_obs.groupBy("ent").agg(F.count("cut").alias("cuts"), F.count_distinct("ed_id").alias("editions")), "ent")
    return chains.suggest_canonical(chains.cluster_splits(r), facts)


@query("k05_scope_fanout")
def k05(t):
    from tideline.functions import levels

    e = t.v_ed.join(t.v_ent, "ent").withColumn("grp", levels.level_group(F.col("level"))).select("ed_id", "yr", "wk", "country", "region", "surface", "lat", "lon", "grp", "start_date")
    return chains.chains_by_scope(e, country_pairs(t), "grp", ["atp", "challenger", "itf"], max_weeks=4)


@query("l01_same_week_duplicates", "WITH k AS (SELECT ed_id, yr, wk, level, lower(city) AS place FROM v_ed e JOIN v_ent n ON n.ent = e.ent UNION SELECT ed_id, yr, wk, level, lower(country) FROM v_ed e JOIN v_ent n ON n.ent = e.ent), g AS (SELECT yr, wk, level, place, string_agg(cast(ed_id AS VARCHAR), ',' ORDER BY ed_id) AS members FROM k GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2) SELECT yr, wk, level, members, min(place) AS place FROM g GROUP BY 1, 2, 3, 4")
def l01(t):
    e = t.v_ed.join(t.v_ent, "ent").select("ed_id", "yr", "wk", "level", F.lower("city").alias("a"), F.lower("country").alias("b"))
    return quality.same_week_duplicates(e, ["yr", "wk", "level"], ["a", "b"])


_E = "(SELECT e.ed_id, yr, wk, CASE WHEN level LIKE 'Ch%' THEN 'challenger' ELSE 'tour' END AS cat, regexp_replace(lower(n.country), '[^a-z0-9]', '', 'g') AS country, regexp_replace(lower(concat(n.region, e.ent % 30)), '[^a-z0-9]', '', 'g') AS name, regexp_replace(lower(n.city), '[^a-z0-9]', '', 'g') AS city, regexp_replace(regexp_replace(lower(n.city), '[ ]+[0-9]+$', ''), '[^a-z0-9]+', '', 'g') AS place, regexp_replace(lower(concat(n.region, e.ent % 30)), '[^a-z0-9]', '', 'g') AS place2 FROM v_ed e JOIN v_ent n ON n.ent = e.ent WHERE level NOT LIKE 'ITF%')"


@query("l02_duplicate_pairs", f"SELECT a.ed_id AS a, b.ed_id AS b FROM {_E} a JOIN {_E} b ON a.yr = b.yr AND a.wk = b.wk AND a.cat = b.cat AND a.ed_id < b.ed_id WHERE (a.country = b.country AND (contains(a.name, b.name) OR contains(b.name, a.name))) OR a.city = b.city OR a.place IN (b.place, b.place2) OR a.place2 IN (b.place, b.place2)")
def l02(t):
    e = t.v_ed.join(t.v_ent.drop("name"), "ent").withColumn("name", F.concat("region", (F.col("ent") % 30).cast("string")))
    return quality.duplicate_pairs(e)


@query("l03_code_winners", """WITH d AS (SELECT ent, city AS code, CASE WHEN ent % 5 = 0 THEN concat('a', ent, '-a', ent) WHEN ent % 5 = 1 THEN concat(slug, '-ch') ELSE slug END AS slug, concat('Event ', ent % 3) AS name, ent % 10 = 0 AS canonical FROM v_ent WHERE city <> 'NATION_3 3'),
s AS (SELECT *, count(*) OVER (PARTITION BY code) AS n, CASE WHEN canonical THEN 1000 ELSE 0 END + CASE WHEN regexp_matches(slug, '\bch\b') THEN 0 ELSE 50 END - CASE WHEN length(slug) % 2 = 1 AND substr(slug, 1, length(slug) // 2) = substr(slug, length(slug) // 2 + 2) AND substr(slug, length(slug) // 2 + 1, 1) = '-' THEN 200 ELSE 0 END - length(slug) AS score, regexp_extract(name, ' ([0-9]+)$', 1) AS num FROM d),
w AS (SELECT code, ent AS winner, num AS wn FROM s WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY code ORDER BY score DESC, ent) = 1),
f AS (SELECT s.code, s.ent, w.winner, bool_or(abs(a.start_date - b.start_date) >= 14) AS far FROM s JOIN w ON w.code = s.code AND s.ent <> w.winner JOIN v_ed a ON a.ent = s.ent JOIN v_ed b ON b.ent = w.winner AND b.yr = a.yr GROUP BY 1, 2, 3)
SELECT s.code, s.ent, w.winner, CASE WHEN coalesce(far, false) OR num <> wn THEN 'distinct' ELSE 'merge' END AS action FROM s JOIN w ON w.code = s.code AND s.ent <> w.winner LEFT JOIN f ON f.code = s.code AND f.ent = s.ent""")
def l03(t):
    e = F.col("ent")
    key = F.concat(F.lit("a"), e.cast("string"))
    slug = F.when(e % 5 == 0, F.concat(key, F.lit("-"), key)).when(e % 5 == 1, F.concat("slug", F.lit("-ch"))).otherwise(F.col("slug"))
    d = t.v_ent.select("ent", F.col("city").alias("code"), slug.alias("slug"), F.concat(F.lit("Event "), (e % 3).cast("string")).alias("name"), (e % 10 == 0).alias("canonical"))
    return quality.code_winners(d, t.v_ed, ["NATION_3 3"])


@query("l04_blocked_merges", """WITH l AS (SELECT ent, list(DISTINCT CASE WHEN level LIKE 'Ch%' THEN 'challenger' WHEN level LIKE 'ATP%' THEN 'atp' ELSE 'other' END) AS kinds FROM v_ed GROUP BY 1), e AS (SELECT n.ent, city, CASE WHEN n.ent % 7 > 0 THEN CASE WHEN n.ent % 9 = 0 THEN region ELSE country END END AS country, CASE WHEN n.ent % 3 > 0 THEN concat(replace(city, ' ', '-'), ', NJ') ELSE slug END AS name, lower(city) AS k, CASE WHEN n.ent % 3 > 0 THEN lower(city) ELSE replace(replace(slug, '-', ' '), '_', ' ') END AS nk, kinds FROM v_ent n JOIN l ON l.ent = n.ent)
SELECT c.ent AS canonical, g.ent AS ghost, CASE WHEN g.country IS NOT NULL AND g.country IS DISTINCT FROM c.country THEN 'country' WHEN replace(g.nk, '_', ' ') <> replace(c.nk, '_', ' ') AND replace(g.nk, '_', ' ') <> replace(c.k, '_', ' ') THEN 'name' WHEN NOT ((list_contains(g.kinds, 'challenger') AND list_contains(c.kinds, 'challenger') AND NOT list_contains(c.kinds, 'atp')) OR (list_contains(g.kinds, 'atp') AND list_contains(c.kinds, 'atp') AND NOT list_contains(c.kinds, 'challenger'))) THEN 'level' END AS blocked FROM e c JOIN e g ON g.city = c.city AND c.ent // 40 % 2 = 0 AND g.ent // 40 % 2 = 1""")
def l04(t):
    kind = F.when(F.col("level").startswith("Ch"), "challenger").when(F.col("level").startswith("ATP"), "atp").otherwise("other")
    kinds = t.v_ed.groupBy("ent").agg(F.collect_set(kind).alias("kinds"))
    name = F.when(F.col("ent") % 3 > 0, F.concat(F.replace("city", F.lit(" "), F.lit("-")), F.lit(", NJ"))).otherwise(F.col("slug"))
    e = t.v_ent.select("ent", "city", F.when(F.col("ent") % 7 > 0, F.when(F.col("ent") % 9 == 0, F.col("region")).otherwise(F.col("country"))).alias("country"), name.alias("name")).join(kinds, "ent")
    side = lambda s: e.select(F.col("city").alias("block"), *(F.col(c).alias(f"{c}_{s}") for c in e.columns))
    half = lambda c: F.floor(F.col(c) / 40) % 2  # noqa: E731  (a city's entities in turn)
    pairs = side("c").where(half("ent_c") == 0).join(side("g").where(half("ent_g") == 1), "block")
    return quality.blocked_merges(pairs).select(F.col("ent_c").alias("canonical"), F.col("ent_g").alias("ghost"), "blocked")


#: The audit's tables: editions with a few wrong weeks, changed surfaces and lengths, snapshots with the day they were written.
_TOUR = "(level LIKE 'ATP%' OR level LIKE 'Ch%' OR level LIKE 'Grand%')"
AUDIT = f"""e AS (SELECT c.ed_id, c.ent, c.yr, c.level, c.start_date, CASE WHEN c.ed_id % 71 = 0 THEN c.wk + 1 ELSE c.wk END AS wk, CASE WHEN c.ed_id % 53 = 0 THEN 'Clay Indoor' ELSE n.surface END AS surface, c.start_date + CASE WHEN c.ed_id % 31 = 0 THEN 20 WHEN c.ed_id % 29 = 0 THEN -1 ELSE 6 END AS end_date FROM v_cal c JOIN v_ent n ON n.ent = c.ent),
sn AS (SELECT s.* REPLACE (CASE WHEN s.ed_id % 211 = 0 THEN direct_rank * 20 WHEN s.ed_id % 29 = 0 AND dr = 'qualifying' THEN direct_rank // 2 ELSE direct_rank END AS direct_rank), CASE WHEN ev = 'doubles' AND s.ed_id % 9 = 0 THEN direct_rank * 15 END AS onsite_rank, e.start_date - cast(s.ed_id % 60 AS INTEGER) AS written FROM v_snap s JOIN e ON e.ed_id = s.ed_id WHERE (s.ed_id % 3 > 0 OR s.ev = 'singles') AND s.ed_id % 7 > 0 AND (s.ed_id % 5 > 0 OR s.dr = 'main')),
cc AS (SELECT ed_id, level, ev, dr, unnest([direct_rank, CASE WHEN ev = 'doubles' THEN adv_rank END, CASE WHEN ev = 'doubles' THEN onsite_rank END]) AS v FROM (SELECT sn.*, level FROM sn JOIN e ON e.ed_id = sn.ed_id WHERE level NOT LIKE 'ITF%')),
dl AS (SELECT ed_id, start_date, CASE kind WHEN 'main' THEN 'singles-main' WHEN 'qualifying' THEN 'singles-qualifying' ELSE 'doubles-main' END AS draw, monday - days AS closed FROM (SELECT *, cast(date_trunc('week', start_date) AS DATE) AS monday, CASE WHEN level = 'Grand Slam' THEN 'slam' WHEN level LIKE 'ATP%' THEN 'tour' WHEN level LIKE 'Ch%' THEN 'challenger' END AS category FROM e) JOIN (VALUES ('tour','main',28),('tour','qualifying',21),('tour','doubles',14),('challenger','main',21),('challenger','qualifying',19),('challenger','doubles',7),('slam','main',42),('slam','doubles',14)) AS r(cat, kind, days) ON cat = category
  UNION ALL SELECT ed_id, start_date, 'singles-qualifying', cast(date_trunc('week', start_date) AS DATE) - 21 FROM e WHERE level = 'Grand Slam Qualifying'),
hv AS (SELECT ed_id, concat(ev, '-', dr) AS draw, max(written) AS written FROM sn WHERE direct_rank IS NOT NULL OR byes IS NOT NULL GROUP BY 1, 2),
du AS (SELECT dl.*, hv.written, hv.ed_id IS NOT NULL AS has, greatest(closed + 3, start_date) < DATE '1998-06-17' AS late FROM dl LEFT JOIN hv ON hv.ed_id = dl.ed_id AND hv.draw = dl.draw WHERE start_date >= DATE '1998-06-08'),
ct AS (SELECT e.*, direct_rank FROM e JOIN sn ON sn.ed_id = e.ed_id AND ev = 'singles' AND dr = 'main' AND direct_rank IS NOT NULL WHERE {_TOUR}),
a1 AS (SELECT ed_id FROM du WHERE start_date < DATE '1998-06-29' GROUP BY 1 HAVING bool_or(late) AND NOT EXISTS (SELECT 1 FROM hv WHERE hv.ed_id = du.ed_id)),
op AS (SELECT * FROM du WHERE start_date < DATE '1998-08-14' AND late AND NOT has AND ed_id NOT IN (SELECT ed_id FROM a1)),
sf AS (SELECT *, regexp_replace(lower(surface), 'indoor|outdoor|[^a-z]', '', 'g') AS bare FROM e WHERE {_TOUR}),
findings AS (SELECT DISTINCT 'C1' AS rule, 'critical' AS severity, ed_id FROM cc WHERE v < CASE WHEN dr = 'qualifying' THEN 30 WHEN level LIKE '%Slam%' THEN CASE WHEN ev = 'doubles' THEN 20 ELSE 30 END WHEN level LIKE '%1000%' THEN CASE WHEN ev = 'doubles' THEN 20 ELSE 25 END WHEN level LIKE '%500%' THEN CASE WHEN ev = 'doubles' THEN 20 ELSE 15 END WHEN level LIKE '%250%' THEN CASE WHEN ev = 'doubles' THEN 20 ELSE 10 END WHEN level LIKE 'Ch%' THEN 50 ELSE 5 END OR v > CASE WHEN ev = 'doubles' THEN 6000 ELSE 2500 END
UNION ALL SELECT 'C2', 'critical', ed_id FROM (SELECT sn.* FROM sn JOIN e ON e.ed_id = sn.ed_id WHERE {_TOUR}) GROUP BY ed_id HAVING max(direct_rank) FILTER (WHERE dr = 'qualifying') < max(direct_rank) FILTER (WHERE ev = 'singles' AND dr = 'main')
UNION ALL SELECT 'C7', 'warn', ed_id FROM e WHERE ed_id % 71 = 0
UNION ALL SELECT 'C9', 'warn', a.ed_id FROM ct a JOIN ct b ON b.ent = a.ent AND b.level = a.level AND b.yr < a.yr GROUP BY a.ed_id, a.direct_rank HAVING count(*) >= 2 AND (a.direct_rank > 2.5 * median(b.direct_rank) OR a.direct_rank < median(b.direct_rank) / 2.5)
UNION ALL SELECT 'C10', 'warn', ed_id FROM (SELECT ed_id, bare, lag(bare) OVER (PARTITION BY ent ORDER BY yr) AS was FROM sf) WHERE was <> bare
UNION ALL SELECT 'C12', 'warn', ed_id FROM e WHERE {_TOUR} AND level NOT LIKE '%1000%' AND (isodow(start_date) BETWEEN 3 AND 6 OR end_date - start_date NOT BETWEEN 0 AND 13)
UNION ALL SELECT 'A1', 'critical', ed_id FROM a1
UNION ALL SELECT 'A2', 'critical', ed_id FROM op WHERE draw = 'singles-main'
UNION ALL SELECT 'A3', 'critical', ed_id FROM op WHERE draw = 'doubles-main' AND ed_id IN (SELECT ed_id FROM sn WHERE ev = 'singles' AND dr = 'main' AND direct_rank IS NOT NULL)
UNION ALL SELECT 'A4', 'warn', ed_id FROM op WHERE draw = 'singles-qualifying' AND ed_id IN (SELECT ed_id FROM sn WHERE ev = 'singles' AND dr = 'main' AND direct_rank IS NOT NULL) AND ed_id NOT IN (SELECT ed_id FROM e WHERE level LIKE 'Grand%')
UNION ALL SELECT DISTINCT 'A5', 'warn', ed_id FROM du WHERE start_date < DATE '1998-07-30' AND late AND written < closed
UNION ALL SELECT DISTINCT 'S1', 'info', ed_id FROM du WHERE start_date >= DATE '1998-06-15' AND start_date < DATE '1998-06-29' AND late AND NOT has)"""


def findings(t):
    k = F.col("ed_id")
    extra = F.when(k % 31 == 0, 20).when(k % 29 == 0, -1).otherwise(6)
    e = t.v_cal.join(t.v_ent.select("ent", "surface"), "ent").select("ed_id", "ent", "yr", "level", "start_date", (F.col("wk") + F.when(k % 71 == 0, 1).otherwise(0)).alias("wk"), F.when(k % 53 == 0, "Clay Indoor").otherwise(F.col("surface")).alias("surface"), F.date_add("start_date", extra).alias("end_date"))
    s = t.v_snap.where("(ed_id % 3 > 0 or ev = 'singles') and ed_id % 7 > 0 and (ed_id % 5 > 0 or dr = 'main')").join(e.select("ed_id", "start_date"), "ed_id").withColumn("written", F.date_sub("start_date", (k % 60).cast("int"))).drop("start_date")
    s = s.withColumn("onsite_rank", F.when((F.col("ev") == "doubles") & (k % 9 == 0), F.col("direct_rank") * 15)).withColumn("direct_rank", F.when(k % 211 == 0, F.col("direct_rank") * 20).when((k % 29 == 0) & (F.col("dr") == "qualifying"), F.floor(F.col("direct_rank") / 2).cast("int")).otherwise(F.col("direct_rank")))
    return quality.audit(e, s, F.to_date(F.lit("1998-06-17")))


@query("l05_l07_audit", f"WITH {AUDIT} SELECT * FROM findings")
def l05(t):
    return findings(t)


@query("l11_severity", f"WITH {AUDIT} SELECT ed_id, max(CASE WHEN severity = 'critical' THEN 2 WHEN severity = 'warn' THEN 1 ELSE 0 END) AS worst, count(*) AS n FROM findings WHERE NOT (rule = 'C12' AND ed_id % 2 = 0) GROUP BY ed_id")
def l11(t):
    ack = t.v_ed.where("ed_id % 2 = 0").select(F.lit("C12").alias("rule"), "ed_id", F.to_date(F.lit("2000-06-01")).alias("until"))  # half of the findings are acknowledged
    return quality.reduce_severity(findings(t), ack, ["ed_id"], F.to_date(F.lit("2000-01-01")))


@query("l08_liveness", "SELECT event_type, count(*) FILTER (WHERE DATE '2024-01-31' - cast(ts AS DATE) < 7) AS week, count(*) FILTER (WHERE DATE '2024-01-31' - cast(ts AS DATE) < 30) AS month, cast(min(DATE '2024-01-31' - cast(ts AS DATE)) AS INTEGER) AS age FROM events GROUP BY 1")
def l08(t):
    return quality.liveness(t.events, "event_type", "ts", F.to_date(F.lit("2024-01-31")))


@query("l08_forward_gaps", "SELECT w AS week, count(ed_id) AS n, CASE WHEN count(ed_id) = 0 THEN 'critical' WHEN count(ed_id) < 25 THEN 'warn' ELSE 'ok' END AS severity FROM (SELECT cast(DATE '2001-06-25' + cast(7 * k AS INTEGER) AS DATE) AS w FROM range(0, 8) r(k)) LEFT JOIN v_ed ON cast(date_trunc('week', start_date) AS DATE) = w GROUP BY 1")
def l08g(t):
    return quality.forward_gaps(t.v_ed, F.to_date(F.lit("2001-06-27")), 8, 25)


@query("l08_holiday_weeks", "SELECT w AS week, count(ed_id) AS n, CASE WHEN count(ed_id) = 0 THEN 'critical' WHEN count(ed_id) < 100000 AND NOT (month(w) = 12 AND day(w) >= 18) THEN 'warn' ELSE 'ok' END AS severity FROM (SELECT cast(DATE '1997-12-08' + cast(7 * k AS INTEGER) AS DATE) AS w FROM range(0, 8) r(k)) LEFT JOIN v_ed ON cast(date_trunc('week', start_date) AS DATE) = w GROUP BY 1")
def l08h(t):
    return quality.forward_gaps(t.v_ed, F.to_date(F.lit("1997-12-10")), 8, 100_000)


#: Cases of the users' first kinds of event; findings and verified keys of a later run by a number of the user.
CASES = "own AS (SELECT user_id, arg_min(event_type, ts) AS rule, user_id * 7 % 31 AS last_day FROM events GROUP BY 1), cases AS (SELECT user_id AS key, rule, CASE user_id % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'open' WHEN 2 THEN 'in_progress' ELSE 'escalated' END AS status, user_id % 4 AS times_seen, user_id % 3 AS attempts FROM own WHERE rule <> 'view'), f AS (SELECT user_id AS key, rule FROM own WHERE last_day >= 20), v AS (SELECT user_id AS key FROM own WHERE last_day < 10)"


def ledger(t):
    own = t.events.groupBy("user_id").agg(F.min_by("event_type", "ts").alias("rule"), (F.col("user_id") * 7 % 31).alias("last_day"))
    u = F.col("user_id")
    status = F.when(u % 4 == 0, "fixed").when(u % 4 == 1, "open").when(u % 4 == 2, "in_progress").otherwise("escalated")
    cases = own.where("rule <> 'view'").select(u.alias("key"), "rule", status.alias("status"), (u % 4).alias("times_seen"), (u % 3).alias("attempts"))
    f = own.where("last_day >= 20").select(u.alias("key"), "rule")
    return quality.sync_ledger(cases, f, ["click"], F.to_timestamp(F.lit("2024-02-01")), own.where("last_day < 10").select(u.alias("key")))


EVENT = "CASE WHEN c.key IS NULL THEN 'opened' WHEN f.key IS NOT NULL AND status = 'fixed' THEN 'reopened' WHEN f.key IS NOT NULL THEN 'seen' WHEN status <> 'fixed' AND (c.rule = 'click' OR c.key IN (SELECT key FROM v)) THEN 'fixed' END"


@query("l12_ledger_state", f"WITH {CASES}, x AS (SELECT coalesce(c.key, f.key) AS key, coalesce(c.rule, f.rule) AS rule, status, times_seen, attempts, f.key IS NOT NULL AS seen, {EVENT} AS event FROM cases c FULL JOIN f ON c.key = f.key) SELECT key, rule, CASE WHEN event IN ('opened', 'reopened') THEN 'open' WHEN event = 'fixed' THEN 'fixed' ELSE status END AS status, coalesce(times_seen, 0) + CASE WHEN seen THEN 1 ELSE 0 END AS times_seen, CASE WHEN event IN ('opened', 'reopened') THEN 0 ELSE attempts END AS attempts FROM x")
def l12(t):
    return ledger(t)[0]


@query("l12_ledger_log", f"WITH {CASES} SELECT coalesce(c.key, f.key) AS key, coalesce(c.rule, f.rule) AS rule, {EVENT} AS event FROM cases c FULL JOIN f ON c.key = f.key WHERE {EVENT} IS NOT NULL")
def l12l(t):
    return ledger(t)[1].select("key", "rule", "event")


def case_rows(t):
    u = F.col("user_id")
    own = t.events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    status = F.when(u % 4 == 0, "fixed").when(u % 4 == 1, "open").when(u % 4 == 2, "in_progress").otherwise("escalated")
    return own.select(u.alias("id"), status.alias("status"), F.when(u % 5 == 0, "critical").otherwise("warn").alias("severity"), (u % 3).alias("attempts"), F.when(u % 2 == 0, F.col("ts")).alias("notified_at"), F.col("ts").alias("resolved_at"))


CASE_ROWS = "c AS (SELECT user_id AS id, CASE user_id % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'open' WHEN 2 THEN 'in_progress' ELSE 'escalated' END AS status, CASE WHEN user_id % 5 = 0 THEN 'critical' ELSE 'warn' END AS severity, user_id % 3 AS attempts, CASE WHEN user_id % 2 = 0 THEN max(ts) END AS notified_at, max(ts) AS resolved_at FROM events GROUP BY user_id)"


@query("l13_ledger_counts", f"WITH {CASE_ROWS} SELECT status, count(*) AS n, count(*) FILTER (WHERE attempts >= 2) AS exhausted FROM c GROUP BY status")
def l13(t):
    return quality.ledger_counts(case_rows(t))


@query("l13_worst_first", f"WITH {CASE_ROWS} SELECT id, status, severity FROM c ORDER BY CASE status WHEN 'escalated' THEN 0 WHEN 'open' THEN 1 WHEN 'in_progress' THEN 2 ELSE 3 END, CASE severity WHEN 'critical' THEN 0 ELSE 1 END, id DESC LIMIT 50")
def l13w(t):
    return quality.worst_first(case_rows(t)).select("id", "status", "severity")


@query("l13_actions", f"WITH {CASE_ROWS}, a AS (SELECT id, CASE WHEN status IN ('open', 'in_progress') THEN CASE WHEN attempts < 2 THEN 'work' ELSE 'escalate' END WHEN status = 'escalated' AND notified_at IS NULL THEN 'tell' WHEN status = 'escalated' AND notified_at < TIMESTAMP '2024-02-05' - INTERVAL 7 DAY THEN 'remind' WHEN status = 'fixed' AND resolved_at > TIMESTAMP '2024-02-05' - INTERVAL 7 DAY THEN 'recent' END AS action FROM c) SELECT * FROM a WHERE action IS NOT NULL")
def l13a(t):
    return quality.ledger_actions(case_rows(t), F.to_timestamp(F.lit("2024-02-05")))


@query("g04_finding_diff", "WITH a AS (SELECT DISTINCT user_id AS key, event_type AS rule FROM events WHERE day(ts) = 3), b AS (SELECT DISTINCT user_id AS key, event_type AS rule FROM events WHERE day(ts) = 4) SELECT coalesce(a.key, b.key) AS key, coalesce(a.rule, b.rule) AS rule, CASE WHEN a.key IS NULL THEN 'fresh' WHEN b.key IS NOT NULL THEN 'kept' WHEN a.rule = 'click' THEN 'resolved' ELSE 'unknown' END AS state FROM a FULL JOIN b ON a.key = b.key AND a.rule = b.rule")
def g04(t):
    day = lambda n: t.events.where(F.dayofmonth("ts") == n).select(F.col("user_id").alias("key"), F.col("event_type").alias("rule")).distinct()
    return sets.finding_diff(day(3), day(4), ["click", "view"], ["view"])


@query("l14_adds_up", "SELECT ed_id, coalesce(direct_rank, 0) + coalesce(alt_rank, 0) = adv_rank AS adds_up FROM v_snap")
def l14(t):
    return t.v_snap.select("ed_id", quality.adds_up(t.v_snap, ["direct_rank", "alt_rank"], "adv_rank").alias("adds_up"))


#: Every nineteenth edition's doubles row says qualifying; some entities are exhibitions, by slug or by name.
SHOWS = "(SELECT c.ed_id, c.level, CASE WHEN n.ent % 50 = 0 THEN concat('united-cup-', n.ent) ELSE n.slug END AS slug, CASE WHEN n.ent % 50 = 1 THEN 'United  Cup' WHEN n.ent % 50 = 2 THEN 'Disunited Cup' ELSE n.name END AS name FROM v_cal c JOIN v_ent n ON n.ent = c.ent)"


@query("l16_invalid_combos", f"SELECT DISTINCT s.ed_id, 'doubles qualifying' AS problem FROM v_snap s JOIN {SHOWS} c ON c.ed_id = s.ed_id WHERE s.ev = 'doubles' AND s.ed_id % 19 = 0 AND level <> 'ATP 500' UNION ALL SELECT ed_id, 'exhibition' FROM {SHOWS} WHERE slug LIKE 'united-cup%' OR name = 'United  Cup'")
def l16(t):
    k = F.col("ent") % 50
    e = t.v_cal.join(t.v_ent, "ent").select("ed_id", "level", F.when(k == 0, F.concat(F.lit("united-cup-"), F.col("ent").cast("string"))).otherwise(F.col("slug")).alias("slug"), F.when(k == 1, "United  Cup").when(k == 2, "Disunited Cup").otherwise(F.col("name")).alias("name"))
    s = t.v_snap.withColumn("dr", F.when((F.col("ev") == "doubles") & (F.col("ed_id") % 19 == 0), "qualifying").otherwise(F.col("dr")))
    return quality.invalid_combos(s, e)


@query("l17_wrong_source_year", "SELECT a.ed_id, CASE WHEN a.ed_id % 2 = 0 AND b.ed_id % 2 = 0 THEN 'keep both' WHEN b.ed_id % 2 = 0 THEN 'drop new' WHEN a.ed_id % 2 = 0 THEN 'drop old' ELSE 'drop both' END AS verdict FROM v_ed a JOIN v_ed b ON a.ent = b.ent AND b.yr = a.yr - 1 AND a.level = b.level")
def l17(t):
    b = t.v_ed.select("ent", (F.col("yr") + 1).alias("yr"), "level", (F.col("ed_id") % 2 == 0).alias("ok_old"))
    pairs = t.v_ed.join(b, ["ent", "yr", "level"]).withColumn("ok_new", F.col("ed_id") % 2 == 0)
    return quality.wrong_source_year(pairs).select("ed_id", "verdict")


@query("l18_reread_text", r"SELECT event_id, cast(nullif(regexp_extract(props, '\"k\": ([0-9]+)', 1), '') AS INTEGER) AS reread FROM events WHERE coalesce(cast(nullif(regexp_extract(props, '\"k\": ([0-9]+)', 1), '') AS INTEGER), -1) <> user_id % 10".replace('\\"', '"'))
def l18(t):
    got = F.nullif(F.regexp_extract("props", '"k": ([0-9]+)', 1), F.lit("")).cast("int")
    return t.events.select("event_id", got.alias("reread"), "user_id").where(F.coalesce("reread", F.lit(-1)) != F.col("user_id") % 10).select("event_id", "reread")


#: Editions with the sources and states of the sweeps: two in eleven are of the official calendar (by source, or by URL alone), one in ten not held.
SWEPT = """sw AS (SELECT c.ed_id, c.yr, c.level, n.slug, n.name, n.city, CASE WHEN c.ed_id % 10 = 0 THEN 'not_held' ELSE 'held' END AS status, CASE WHEN c.ed_id % 11 = 0 THEN 'atp_official_calendar_pdf' ELSE 'import' END AS source, CASE WHEN c.ed_id % 11 = 1 THEN concat('https://x/Calendar-PDFs/', c.yr) WHEN c.ed_id % 11 = 2 THEN 'https://y/page' END AS source_url,
 EXISTS (SELECT 1 FROM v_snap s WHERE s.ed_id = c.ed_id AND s.adv_rank IS NOT NULL) AS cuts, n.ent % 3 = 0 AS known FROM v_cal c JOIN v_ent n ON n.ent = c.ent),
dr AS (SELECT concat(n_name, '-1') AS pattern, 1993 + n_nationkey % 4 AS final_year FROM nation WHERE n_regionkey = 1), cr AS (SELECT n_name AS pattern, 1994 + n_nationkey % 4 AS year FROM nation WHERE n_regionkey = 2 UNION ALL SELECT concat(n_name, ' 17'), 1996 FROM nation)"""


@query("l19_sweep_status", f"""WITH {SWEPT}, r AS (SELECT *, CASE WHEN status = 'held' AND yr = 1997 AND NOT known AND level NOT ILIKE 'ITF%' AND NOT cuts AND source <> 'atp_official_calendar_pdf' AND coalesce(source_url, '') NOT ILIKE '%atppz.com%' AND coalesce(source_url, '') NOT ILIKE '%/calendar-pdfs/%' THEN 'stale'
 WHEN status = 'held' AND level NOT ILIKE 'ITF%' AND EXISTS (SELECT 1 FROM dr WHERE sw.yr > dr.final_year AND (contains(lower(sw.slug), lower(dr.pattern)) OR contains(lower(sw.name), lower(dr.pattern)))) THEN 'discontinued'
 WHEN status = 'held' AND level NOT ILIKE 'ITF%' AND EXISTS (SELECT 1 FROM cr WHERE sw.yr = cr.year AND (contains(lower(sw.slug), lower(cr.pattern)) OR contains(lower(sw.name), lower(cr.pattern)) OR contains(lower(sw.city), lower(cr.pattern)))) THEN 'cancelled' WHEN status = 'not_held' AND cuts THEN 'restored' END AS reason FROM sw)
SELECT ed_id, CASE WHEN reason = 'restored' THEN 'held' WHEN reason IS NOT NULL THEN 'not_held' ELSE status END AS status, reason FROM r""")
def l19(t):
    k, n = F.col("ed_id"), F.col("n_nationkey")
    url = F.when(k % 11 == 1, F.concat(F.lit("https://x/Calendar-PDFs/"), F.col("yr").cast("string"))).when(k % 11 == 2, "https://y/page")
    e = t.v_cal.join(t.v_ent, "ent").select("ed_id", "yr", "level", "slug", "name", "city", F.when(k % 10 == 0, "not_held").otherwise("held").alias("status"), F.when(k % 11 == 0, "atp_official_calendar_pdf").otherwise("import").alias("source"), url.alias("source_url"))
    gone = t.nation.where("n_regionkey = 1").select(F.concat("n_name", F.lit("-1")).alias("pattern"), (n % 4 + 1993).alias("final_year"))
    off = t.nation.where("n_regionkey = 2").select(F.col("n_name").alias("pattern"), (n % 4 + 1994).alias("year")).unionByName(t.nation.select(F.concat("n_name", F.lit(" 17")).alias("pattern"), F.lit(1996).cast("bigint").alias("year")))
    return quality.sweep_status(e, t.v_ent.where("ent % 3 = 0").select("slug"), 1997, gone, off, t.v_snap.where("adv_rank is not null").select("ed_id"))


#: Headers of several seasons of a code, some with another level, a few codes without any.
HEADERS = "h AS (SELECT ent AS code, yr AS season, CASE WHEN ed_id % 7 = 0 THEN 'Challenger 50' ELSE level END AS level, ent % 4 = 0 AS heuristic FROM v_ed WHERE (ent + yr) % 3 > 0)"


@query("l20_audit_levels", f"WITH {HEADERS} SELECT e.ed_id, CASE WHEN e.ent % 11 = 0 THEN 'missing code' WHEN h.code IS NULL THEN 'unverifiable' WHEN h.heuristic THEN CASE WHEN regexp_matches(e.level, '^ATP [0-9]+') THEN 'confirmed' ELSE 'mismatch' END WHEN h.level = e.level THEN 'confirmed' ELSE 'mismatch' END AS verdict FROM v_ed e LEFT JOIN h ON h.code = e.ent AND h.season = e.yr AND e.ent % 11 > 0")
def l20(t):
    h = t.v_ed.where("(ent + yr) % 3 > 0").select(F.col("ent").alias("code"), F.col("yr").alias("season"), F.when(F.col("ed_id") % 7 == 0, "Challenger 50").otherwise(F.col("level")).alias("level"), (F.col("ent") % 4 == 0).alias("heuristic"))
    return quality.audit_levels(t.v_ed.withColumn("code", F.when(F.col("ent") % 11 > 0, F.col("ent"))), h)


@query("l21_completeness_gate", "SELECT event_id FROM events WHERE cast(ts AS DATE) IN (SELECT cast(ts AS DATE) FROM events WHERE value > 90 GROUP BY 1 HAVING count(DISTINCT event_type) >= 5) AND value > 90")
def l21(t):
    return quality.completeness_gate(t.events.where("value > 90").withColumn("day", F.to_date("ts")), "day", "event_type", 5).select("event_id")


def two_snaps(t):
    a = t.v_snap.where("ev = 'singles' and dr = 'main' and ed_id % 3 > 0").select("ed_id", "direct_rank", "alt_rank")
    b = t.v_snap.where("ev = 'singles' and dr = 'qualifying' and ed_id % 4 > 0").select("ed_id", "direct_rank", "alt_rank")
    return a, b


TWO = "a AS (SELECT ed_id, direct_rank, alt_rank FROM v_snap WHERE ev = 'singles' AND dr = 'main' AND ed_id % 3 > 0), b AS (SELECT ed_id, direct_rank, alt_rank FROM v_snap WHERE ev = 'singles' AND dr = 'qualifying' AND ed_id % 4 > 0)"
for _policy, _sql in {
    "incoming_wins": "CASE WHEN b.ed_id IS NOT NULL THEN b.{c} ELSE a.{c} END",
    "existing_wins": "CASE WHEN a.ed_id IS NOT NULL THEN a.{c} ELSE b.{c} END",
    "coalesce_existing": "coalesce(a.{c}, b.{c})",
    "coalesce_incoming": "coalesce(b.{c}, a.{c})",
}.items():
    query(f"m01_upsert_{_policy}", f"WITH {TWO} SELECT coalesce(a.ed_id, b.ed_id) AS ed_id, {_sql.format(c='direct_rank')} AS direct_rank, {_sql.format(c='alt_rank')} AS alt_rank FROM a FULL JOIN b ON a.ed_id = b.ed_id")(
        lambda t, p=_policy: merge.upsert(*two_snaps(t), ["ed_id"], p)
    )


@query("m02_block_preserve", f"WITH {TWO} SELECT a.ed_id, CASE WHEN b.direct_rank IS NOT NULL THEN b.direct_rank ELSE a.direct_rank END AS direct_rank, coalesce(b.alt_rank, a.alt_rank) AS alt_rank FROM a LEFT JOIN b ON a.ed_id = b.ed_id")
def m02(t):
    return merge.block_preserve(*two_snaps(t), ["ed_id"], ["direct_rank"], ["alt_rank"])


@query("m03_source_precedence", f"WITH {TWO} SELECT a.ed_id, CASE WHEN a.ed_id % 2 = 0 THEN 'official' ELSE 'feed' END AS source, CASE WHEN a.ed_id % 2 = 0 THEN a.direct_rank ELSE coalesce(b.direct_rank, a.direct_rank) END AS direct_rank FROM a LEFT JOIN b ON a.ed_id = b.ed_id")
def m03(t):
    a, b = two_snaps(t)
    return merge.source_precedence(a.withColumn("source", F.when(F.col("ed_id") % 2 == 0, "official").otherwise("feed")), b, ["ed_id"], ["direct_rank"], "official")


@query("m04_tombstones", f"WITH {TWO} SELECT ed_id, CASE WHEN alt_rank IS NULL AND ed_id % 2 = 0 AND ed_id % 10 > 2 THEN 'NOT_FOUND' END AS note FROM a")
def m04(t):
    a, _ = two_snaps(t)
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    a = a.withColumn("note", F.lit(None).cast("string")).withColumn("looked_at", F.when(F.col("ed_id") % 10 <= 2, F.to_timestamp(F.lit("2024-01-01 20:00:00"))))
    return merge.tombstones(a, a.where("ed_id % 2 = 0").select("ed_id"), ["ed_id"], "alt_rank", now).select("ed_id", "note")


@query("m05_fill_only", f"WITH {TWO} SELECT coalesce(a.ed_id, b.ed_id) AS ed_id, coalesce(a.alt_rank, b.alt_rank) AS alt_rank FROM a FULL JOIN b ON a.ed_id = b.ed_id")
def m05(t):
    return merge.fill_only(*two_snaps(t), ["ed_id"], "alt_rank")


@query("m06_merge_entities", "WITH m AS (SELECT ed_id, CASE WHEN ent IN (1, 2, 3) THEN 1 WHEN ent % 40 < 4 THEN ent - ent % 40 ELSE ent END AS ent, yr, cut FROM v_obs WHERE ev = 'singles' AND dr = 'main'), g AS (SELECT *, CASE WHEN start_date - lag(start_date) OVER w < 14 THEN 0 ELSE 1 END AS n FROM (SELECT m.ed_id, m.ent, m.yr, e.start_date, m.cut FROM m JOIN v_ed e ON e.ed_id = m.ed_id) WINDOW w AS (PARTITION BY ent, yr ORDER BY start_date, ed_id)), k AS (SELECT *, sum(n) OVER (PARTITION BY ent, yr ORDER BY start_date, ed_id) AS ev FROM g) SELECT ent, yr, arg_min(ed_id, (start_date, ed_id)) AS ed_id, min(start_date) AS start_date, arg_min(cut, (start_date, ed_id)) FILTER (WHERE cut IS NOT NULL) AS cut, count(*) AS folded FROM k GROUP BY ent, yr, ev")
def m06(t):
    e = t.v_ed.join(t.v_obs.where("ev = 'singles' and dr = 'main'").select("ed_id", "cut"), "ed_id").select("ed_id", "ent", "yr", "start_date", "cut")
    mapping = t.v_ent.where("ent % 40 between 1 and 3 and ent > 1").select(F.col("ent").alias("loser"), (F.col("ent") - 1).alias("winner")).where("winner > 0")
    return merge.merge_entities(e, mapping)


@query("m06_repoint", "SELECT DISTINCT o_custkey % 100 AS usr, CASE WHEN o_custkey % 40 IN (1, 2, 3) AND o_custkey > 3 THEN o_custkey - o_custkey % 40 WHEN o_custkey BETWEEN 1 AND 3 THEN 1 ELSE o_custkey END AS ent FROM orders")
def m06r(t):
    mapping = t.v_ent.where("ent % 40 between 1 and 3 and ent > 1").select(F.col("ent").alias("loser"), (F.col("ent") - 1).alias("winner")).where("winner > 0")
    return merge.repoint(t.orders.select((F.col("o_custkey") % 100).alias("usr"), F.col("o_custkey").alias("ent")), mapping, "usr")


@query("m07_refile_seasons", """WITH e AS (SELECT ed_id, concat('s', ent % 40, CASE WHEN ent % 3 > 0 THEN concat('-', ent % 3 + 1) ELSE '' END) AS slug, CASE WHEN month(start_date) = 12 AND ent % 2 = 0 THEN yr + 1 ELSE yr END AS yr, start_date, level FROM v_ed), w AS (SELECT *, year(start_date) + CASE WHEN start_date >= cast(date_trunc('week', make_date(year(start_date) + 1, 1, 5)) AS DATE) - 7 THEN 1 ELSE 0 END AS season FROM e), m AS (SELECT * FROM w WHERE season = yr - 1 AND level NOT LIKE 'ITF%'),
r AS (SELECT slug, yr, arg_min(start_date, ed_id) AS d, min(ed_id) AS id FROM e GROUP BY 1, 2), f AS (SELECT m.ed_id, min(k) AS k FROM m, (VALUES (2), (3), (4)) s(k) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.slug = concat(m.slug, '-', k) AND r.yr = m.season) GROUP BY 1)
SELECT m.ed_id, cast(m.season AS INTEGER) AS season, CASE WHEN r.id IS NULL THEN 'move' WHEN abs(m.start_date - r.d) < 14 THEN 'fold' WHEN f.k IS NOT NULL THEN 'split' ELSE 'conflict' END AS action, CASE WHEN r.id IS NULL THEN NULL WHEN abs(m.start_date - r.d) < 14 THEN cast(r.id AS VARCHAR) WHEN f.k IS NOT NULL THEN concat(m.slug, '-', f.k) END AS into_id FROM m LEFT JOIN r ON r.slug = m.slug AND r.yr = m.season LEFT JOIN f ON f.ed_id = m.ed_id""")
def m07(t):
    from tideline.functions import dates

    e = F.col("ent")
    tail = F.when(e % 3 > 0, F.concat(F.lit("-"), (e % 3 + 1).cast("string"))).otherwise("")
    late = (F.month("start_date") == 12) & (e % 2 == 0)
    rows = t.v_ed.select("ed_id", F.concat(F.lit("s"), (e % 40).cast("string"), tail).alias("slug"), (F.col("yr") + F.when(late, 1).otherwise(0)).alias("yr"), "start_date", "level")
    return merge.refile_seasons(rows, dates.season_of(F.col("start_date"))).withColumnRenamed("into", "into_id")


@query("m08_distinct_slugs", "WITH o AS (SELECT o_orderkey AS ed_id, cast(year(o_orderdate) AS INTEGER) AS yr, cast(o_orderdate AS DATE) AS start_date, cast(o_custkey AS VARCHAR) AS slug FROM orders), g AS (SELECT *, CASE WHEN start_date - lag(start_date) OVER w >= 14 THEN 1 ELSE 0 END AS n FROM o WINDOW w AS (PARTITION BY slug, yr ORDER BY start_date, ed_id)), k AS (SELECT *, sum(n) OVER (PARTITION BY slug, yr ORDER BY start_date, ed_id) + 1 AS n2 FROM g) SELECT ed_id, CASE WHEN n2 = 1 THEN slug ELSE concat(slug, '-', n2) END AS new_slug FROM k")
def m08(t):
    o = t.orders.select(F.col("o_orderkey").alias("ed_id"), F.year("o_orderdate").alias("yr"), F.col("o_orderdate").cast("date").alias("start_date"), F.col("o_custkey").cast("string").alias("slug"))
    return merge.distinct_slugs(o, "slug").select("ed_id", "new_slug")


@query("m09_copy_facts", "WITH e AS (SELECT ed_id, ent, yr FROM v_ed), s AS (SELECT ed_id, ev, dr, direct_rank FROM v_snap), p AS (SELECT ent, max(ed_id) FILTER (WHERE yr = 1996) AS src, max(ed_id) FILTER (WHERE yr = 1997) AS dst FROM e GROUP BY ent), k AS (SELECT ed_id, ev, dr, direct_rank, 0 AS moved FROM s UNION ALL SELECT p.dst, s.ev, s.dr, s.direct_rank, 1 FROM s JOIN p ON p.src = s.ed_id WHERE p.dst IS NOT NULL) SELECT ed_id, ev, dr, direct_rank FROM k QUALIFY row_number() OVER (PARTITION BY ed_id, ev, dr ORDER BY moved DESC) = 1")
def m09(t):
    a, b = t.v_ed.where("yr = 1996").select("ent", F.col("ed_id").alias("src")), t.v_ed.where("yr = 1997").select("ent", F.col("ed_id").alias("dst"))
    return merge.copy_facts(t.v_snap, a.join(b, "ent").select("src", "dst"))


@query("m11_recompute_weeks", "SELECT ed_id, CASE WHEN yr + CASE WHEN start_date >= cast(date_trunc('week', make_date(yr + 1, 1, 5)) AS DATE) - 7 THEN 1 ELSE 0 END = yr OR level LIKE 'ITF%' THEN greatest(1, cast(floor((start_date - cast(date_trunc('week', make_date(yr, 1, 5)) AS DATE)) / 7) AS INTEGER) + 1) ELSE wk END AS wk FROM (SELECT *  REPLACE (wk + 1 AS wk) FROM v_ed)")
def m11(t):
    """Stored weeks are one off; those of editions in their season are made anew."""
    return merge.recompute_weeks(t.v_ed.withColumn("wk", F.col("wk") + 1)).select("ed_id", "wk")


@query("m11_clean_names", r"SELECT ent, trim(regexp_replace(name, '\s+[Cc][Hh](\s+\d+)?$', '')) AS name, trim(regexp_replace(city, '\s+[Cc][Hh](\s+\d+)?$', '')) AS city FROM (SELECT ent, concat(name, CASE ent % 4 WHEN 0 THEN ' CH 2' WHEN 1 THEN ' ch' ELSE '' END) AS name, concat(city, CASE ent % 3 WHEN 0 THEN ' Ch 75' WHEN 1 THEN ' Church 2' ELSE '' END) AS city FROM v_ent) WHERE regexp_matches(name, '(?i)\s+ch(\s+\d+)?$') OR regexp_matches(city, '(?i)\s+ch(\s+\d+)?$')")
def m11n(t):
    k = F.col("ent")
    e = t.v_ent.select("ent", F.concat("name", F.when(k % 4 == 0, " CH 2").when(k % 4 == 1, " ch").otherwise("")).alias("name"), F.concat("city", F.when(k % 3 == 0, " Ch 75").when(k % 3 == 1, " Church 2").otherwise("")).alias("city"))
    return merge.clean_names(e)


@query("m12_first_run", "SELECT DISTINCT o_custkey AS ent, true AS baseline FROM orders")
def m12f(t):
    """Nothing was known before: everything is the baseline and nothing is announced as new."""
    every = t.orders.select(F.col("o_custkey").alias("ent")).distinct()
    return merge.announce_new(every, every.where("false"), "ent")


@query("m12_announce_new", "SELECT DISTINCT o_custkey AS ent, false AS baseline FROM orders WHERE year(o_orderdate) = 1997 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) < 1997)")
def m12(t):
    at = lambda c: t.orders.where(c).select(F.col("o_custkey").alias("ent")).distinct()
    return merge.announce_new(at(F.year("o_orderdate") == 1997), at(F.year("o_orderdate") < 1997), "ent")


@query("m13_apply_aliases", "SELECT ent, CASE WHEN country = 'NATION_1' THEN 'NATION_2' ELSE country END AS country FROM v_ent")
def m13(t):
    al = t.spark.createDataFrame([("NATION_1", "NATION_2"), ("NATION_3", "NOWHERE")], "alias string, canonical string")
    return merge.apply_aliases(t.v_ent.select("ent", "country"), al, "country")


@query("m14_clone_to_year", "SELECT ent, 2001 AS yr, cast(arg_max(start_date, yr) + cast((2001 - max(yr)) * 364 AS INTEGER) AS DATE) AS start_date, arg_max(level, yr) AS level, arg_max(ed_id, yr) AS template FROM v_ed WHERE yr < 2001 AND ent NOT IN (SELECT ent FROM v_ed WHERE yr = 2001) GROUP BY ent")
def m14(t):
    return merge.clone_to_year(t.v_ed, 2001)


@query("m13_apply_overrides", "SELECT ent, CASE WHEN ent % 50 = 7 THEN 'SET' ELSE country END AS country, CASE WHEN ent % 50 = 7 AND ent % 100 = 7 THEN 'Clay' ELSE surface END AS surface, ent % 50 = 7 AS rewritten FROM v_ent")
def m13o(t):
    o = t.v_ent.where("ent % 50 = 7").select("ent", F.lit("SET").alias("country"), F.when(F.col("ent") % 100 == 7, "Clay").alias("surface"))  # overrides are few
    return merge.apply_overrides(t.v_ent.select("ent", "country", "surface"), o, "ent", ["country", "surface"])


@query("m15_upgrade_identity", "WITH r AS (SELECT e.ent AS code, arg_max(cast(ed_id AS VARCHAR), yr) AS name, arg_max(e.level, yr) AS level, any_value(n.city) AS city, any_value(n.country) AS country FROM v_ed e JOIN v_ent n ON n.ent = e.ent GROUP BY e.ent) SELECT e.ed_id, coalesce(r.name, '-') AS name, coalesce(r.city, '?') AS city, r.country, CASE WHEN e.ed_id % 2 = 0 AND r.level LIKE 'ATP%' THEN r.level ELSE e.level END AS level FROM v_ed e LEFT JOIN r ON r.code = e.ent")
def m15(t):
    reg = t.v_ed.join(t.v_ent.drop("name"), "ent").select(F.col("ent").alias("code"), F.col("ed_id").cast("string").alias("name"), "city", "country", "level", "yr")
    rows = t.v_ed.select("ed_id", F.col("ent").alias("code"), F.lit("-").alias("name"), F.lit("?").alias("city"), F.lit(None).cast("string").alias("country"), "level", (F.col("ed_id") % 2 == 0).alias("heuristic"))
    return merge.upgrade_identity(rows, reg, "code").select("ed_id", "name", "city", "country", "level")


@query("a10_change_set", f"WITH {TWO} SELECT coalesce(a.ed_id, b.ed_id) AS ed_id, CASE WHEN a.ed_id IS NULL THEN 'insert' WHEN b.ed_id IS NULL THEN 'delete' ELSE 'update' END AS op FROM a FULL JOIN b ON a.ed_id = b.ed_id WHERE a.ed_id IS NULL OR b.ed_id IS NULL OR a.direct_rank IS DISTINCT FROM b.direct_rank OR a.alt_rank IS DISTINCT FROM b.alt_rank")
def a10(t):
    return merge.change_set(*two_snaps(t), ["ed_id"])




@query("l09_alert_liveness", "WITH s AS (SELECT level AS category, count(*) AS subscribers FROM v_ed WHERE yr = 1996 GROUP BY 1), p AS (SELECT level AS category, count(*) AS passed FROM v_ed WHERE start_date < DATE '1999-01-01' GROUP BY 1), n AS (SELECT level AS category, count(*) AS sent FROM v_ed WHERE level NOT LIKE 'ITF%' GROUP BY 1) SELECT category, subscribers, passed, coalesce(sent, 0) AS sent, CASE WHEN coalesce(sent, 0) = 0 THEN 'critical' ELSE 'ok' END AS severity FROM s JOIN p USING (category) LEFT JOIN n USING (category)")
def l09(t):
    e = t.v_ed.withColumnRenamed("level", "category")
    return quality.alert_liveness(e.where("yr = 1996"), e.withColumnRenamed("start_date", "due"), e.where("category not like 'ITF%'"), F.to_date(F.lit("1999-01-01")))


@query("m10_promote_metadata", f"WITH {LADDER}, a AS (SELECT *, row_number() OVER (PARTITION BY xid ORDER BY score DESC, days, gid) AS r1 FROM sc WHERE score IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY score DESC, days, xid) AS r2 FROM a WHERE r1 = 1) SELECT g.ed_id AS gid, b.xid, coalesce(b.x_level, g.level) AS level FROM v_generic g LEFT JOIN b ON b.gid = g.ed_id AND b.r2 = 1")
def m10(t):
    return merge.promote_metadata(t.v_named, t.v_generic, ["level"])


@query("k01_chain_labels", f"""WITH RECURSIVE e AS ({EDGES}), {REACH}, m AS (SELECT c.component AS chain, v.yr, v.wk, v.ed_id, v.country, d.start_date FROM comp c JOIN {CHAIN} v ON v.ed_id = c.node JOIN v_ed d ON d.ed_id = v.ed_id),
f AS (SELECT chain, arg_min(yr, (wk, ed_id)) AS yr, arg_min(wk, (wk, ed_id)) AS wk, concat(arg_min(country, (wk, ed_id)), ' ', strftime(arg_min(start_date, (wk, ed_id)), '%b')) AS label FROM m GROUP BY chain),
g AS (SELECT chain, yr, CASE WHEN count(*) OVER (PARTITION BY yr, label) > 1 THEN concat(label, ' W', wk) ELSE label END AS label FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY yr, label ORDER BY chain) AS k FROM g)
SELECT chain, CASE WHEN k > 1 THEN concat(label, ' #', k) ELSE label END AS label FROM h""")
def k01l(t):
    e = t.v_ed.join(t.v_ent, "ent").select("ed_id", "yr", "wk", "country", "region", "surface", "lat", "lon", "start_date")
    return chains.chain_labels(chains.chain_members(e, country_pairs(t)))
