"""Queries of predicates, scalar functions and classifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import cuts, dates, geo, levels, text
from tideline.operators import basics
from tideline.plans.catalog import query

#: Marks taken off by the other engine's own decomposition, and the two letters that have none to take off.
FOLD = "translate(strip_accents(lower(x)), 'łđ', 'ld')"
TITLES = "(SELECT doc_id, coalesce(text, '') AS x FROM documents)"


def titles(t):
    return t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("x"))


def X():  # noqa: N802
    return F.col("x")


@query("h01_city_key", f"SELECT doc_id, regexp_replace({FOLD}, '[^a-z0-9]+', '', 'g') AS city_key, regexp_replace({FOLD.replace('(x)', "(replace(x, '&', 'and'))")}, '[^a-z0-9]+', '', 'g') AS norm_key FROM {TITLES}")
def h01(t):
    return titles(t).select("doc_id", text.city_key(X()).alias("city_key"), text.normalize_key(X()).alias("norm_key"))


NAMES = "(SELECT ent, concat(city, CASE WHEN ent % 9 = 0 THEN ' ch' WHEN ent % 3 = 0 THEN ' CH 75' WHEN ent % 3 = 1 THEN ' (Indoor), NJ' ELSE ' II' END) AS x FROM v_ent)"


def names(t):
    tail = F.when(F.col("ent") % 9 == 0, " ch").when(F.col("ent") % 3 == 0, " CH 75").when(F.col("ent") % 3 == 1, " (Indoor), NJ").otherwise(" II")
    return t.v_ent.select("ent", F.concat("city", tail).alias("x"))


@query(
    "h02_h04_keys",
    rf"""WITH n AS (SELECT ent, {FOLD} AS x FROM {NAMES}),
s AS (SELECT ent, x, regexp_replace(regexp_replace(x, '\s+ch(\s+\d+)?$', ''), '[^a-z0-9]+', '', 'g') AS strict_key FROM n)
SELECT ent, strict_key, regexp_replace(strict_key, '[0-9]+$', '') AS base_key,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\s*\([^)]*\)', '', 'g'), '\s+ch(\s+\d+)?$', ''), '\s+\d+$', ''), ',\s*[a-z]{{2}}$', ''), '[^a-z0-9]+', '', 'g') AS schedule_key,
 regexp_replace(regexp_replace(trim(regexp_replace(trim(regexp_replace(x, '\([^)]*\)', ' ', 'g')), ',[ ]*[a-z][a-z]$', '')), '[ ]+([0-9]+|i{{1,3}}|iv|v)$', ''), '[^a-z0-9]+', '', 'g') AS place_key
FROM s""",
)
def h02(t):
    return names(t).select("ent", text.strict_key(X()).alias("strict_key"), text.base_key(X()).alias("base_key"), text.schedule_name_key(X()).alias("schedule_key"), text.place_key(X()).alias("place_key"))


@query("h05_contains_key", "SELECT n_nationkey, r_regionkey, length(n_name) >= 5 AND length(r_name) >= 5 AND (contains(n_name, r_name) OR contains(r_name, n_name)) AS hit FROM nation, region WHERE n_regionkey = r_regionkey")
def h05(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_regionkey", text.contains_key(F.col("n_name"), F.col("r_name")).alias("hit"))


@query("h06_name_keys", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace({FOLD}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))), ' ') AS sorted_key FROM {TITLES}")
def h06(t):
    return titles(t).select("doc_id", text.sorted_name_key(X()).alias("sorted_key"))


@query("h07_display_name", r"SELECT c_custkey, trim(regexp_replace(replace(c_name, '#', ', '), '^([^,]+),[ ]*(.+)$', '\2 \1')) AS shown FROM customer")
def h07(t):
    return t.customer.select("c_custkey", text.display_name(F.replace("c_name", F.lit("#"), F.lit(", "))).alias("shown"))


@query("h08_series_number", "SELECT ent, cast(nullif(regexp_extract(city, '(?:^|[^0-9])([0-9]{1,2})$', 1), '') AS INTEGER) AS number, coalesce(cast(nullif(regexp_extract(city, '(?:^|[^0-9])([0-9]{1,2})$', 1), '') AS INTEGER), 1) <> coalesce(cast(nullif(regexp_extract(slug, '(?:^|[^0-9])([0-9]{1,2})$', 1), '') AS INTEGER), 1) AS differs FROM v_ent")
def h08(t):
    return t.v_ent.select("ent", text.series_number(F.col("city")).alias("number"), text.differently_numbered(F.col("city"), F.col("slug")).alias("differs"))


@query(
    "h09_season_week",
    """SELECT o_orderkey, cast(date_trunc('week', make_date(y, 1, 5)) AS DATE) AS season_start,
 greatest(1, cast(floor((d - cast(date_trunc('week', make_date(y, 1, 5)) AS DATE)) / 7) AS INTEGER) + 1) AS season_week,
 y + CASE WHEN d >= cast(date_trunc('week', make_date(y + 1, 1, 5)) AS DATE) - 7 THEN 1 ELSE 0 END AS season
FROM (SELECT o_orderkey, cast(o_orderdate AS DATE) AS d, cast(year(o_orderdate) AS INTEGER) AS y FROM orders)""",
)
def h09(t):
    d, y = F.col("d"), F.col("y")
    o = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")).withColumn("y", F.year("d"))
    return o.select("o_orderkey", dates.season_start(y).alias("season_start"), dates.season_week(d, y).alias("season_week"), dates.season_of(d).alias("season"))


@query(
    "h10_weeks",
    """SELECT o_orderkey, cast(date_trunc('week', d) AS DATE) AS monday, d - cast((isodow(d) + 1) % 7 + 1 AS INTEGER) AS friday,
 cast(greatest(1, (cast(date_trunc('week', d + n) AS DATE) - cast(date_trunc('week', d) AS DATE)) // 7 + 1) AS INTEGER) AS span
FROM (SELECT o_orderkey, cast(o_orderdate AS DATE) AS d, cast(o_orderkey % 15 AS INTEGER) AS n FROM orders)""",
)
def h10(t):
    o = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderkey") % 15).cast("int").alias("n"))
    d = F.col("d")
    return o.select("o_orderkey", dates.monday_of(d).alias("monday"), dates.friday_before(d).alias("friday"), dates.week_span(d, F.date_add(d, F.col("n"))).alias("span"))


@query(
    "h11_deadline_moment",
    """WITH x AS (SELECT ed_id, start_date AS d, level, make_date(year(start_date), 3, 8) AS a, make_date(year(start_date), 11, 1) AS b FROM v_ed)
SELECT ed_id, CASE WHEN level LIKE 'ITF%' THEN cast(d AS TIMESTAMP) + INTERVAL 14 HOUR
  WHEN d >= a + cast((7 - isodow(a)) % 7 AS INTEGER) AND d < b + cast((7 - isodow(b)) % 7 AS INTEGER) THEN cast(d AS TIMESTAMP) + INTERVAL 16 HOUR
  ELSE cast(d AS TIMESTAMP) + INTERVAL 17 HOUR END AS due FROM x""",
)
def h11(t):
    return t.v_ed.select("ed_id", dates.deadline_moment(F.col("start_date"), ~F.col("level").startswith("ITF")).alias("due"))


HAV = "2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query("h12_h13_geo", f"WITH a AS (SELECT * FROM v_ent), b AS (SELECT ent - 1 AS ent, lat, lon, surface FROM v_ent), k AS (SELECT a.ent, a.surface AS s1, b.surface AS s2, {HAV.format(a='a', b='b')} AS km FROM a JOIN b ON a.ent = b.ent) SELECT ent, round(km, 6) AS km, round(greatest(0.03, exp(-km / 1200)), 6) AS w_geo, CASE WHEN s1 = s2 THEN 1.0e0 WHEN s1 = 'Grass' OR s2 = 'Grass' THEN 0.3e0 ELSE 0.55e0 END AS w_surface FROM k")
def h12(t):
    a, b = t.v_ent.alias("a"), t.v_ent.alias("b")
    km = geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    no = F.lit(False)
    return a.join(b, F.col("a.ent") == F.col("b.ent") - 1).select(F.col("a.ent").alias("ent"), F.round(km, 6).alias("km"), F.round(geo.w_geo(km), 6).alias("w_geo"), levels.w_surface(F.col("a.surface"), F.col("b.surface"), no, no).alias("w_surface"))


@query("h14_clamp", "SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS clamped, round(pow(abs(c_acctbal), 0.25e0), 6) AS damped, round(least(greatest(c_acctbal, 3000 / 1.75e0), 3000 * 1.75e0), 6) AS wins, floor(c_acctbal / 3 + 0.5e0) AS half_up FROM customer")
def h14(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", geo.clamp(b, 0.0, 5000.0).alias("clamped"), F.round(geo.damp(F.abs(b), 0.25), 6).alias("damped"), F.round(geo.winsorize(b, F.lit(3000.0), 1.75), 6).alias("wins"), geo.half_up(b / 3).alias("half_up"))


@query("h15_region_label", "SELECT ent, CASE WHEN lon >= -30 AND lon <= 45 AND lat >= 34 THEN 'Europe' WHEN lon >= -20 AND lon <= 55 AND lat < 34 AND lat > -40 THEN 'Africa & Middle East' WHEN lon > 45 AND lon <= 150 AND lat >= 5 THEN 'Asia' WHEN lon > 100 AND lat < 5 THEN 'Oceania' WHEN lon < -30 AND lat >= 15 THEN 'North America' WHEN lon < -30 AND lat < 15 THEN 'South America' ELSE 'Elsewhere' END AS area FROM v_ent")
def h15(t):
    return t.v_ent.select("ent", geo.region_label(F.col("lat"), F.col("lon")).alias("area"))


@query("h16_labels", "SELECT o_orderkey, strftime(o_orderdate, '%b') AS month, CASE WHEN o_totalprice < 1000 THEN 'close' WHEN o_totalprice < 100000 THEN 'near' ELSE 'far' END AS band FROM orders")
def h16(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "MMM").alias("month"), basics.band_label(F.col("o_totalprice"), [(1000, "close"), (100000, "near")], "far").alias("band"))


@query("h17_fingerprint", "SELECT event_id, sha256(concat(cast(user_id AS VARCHAR), '|', coalesce(event_type, ''), '|', coalesce(props, ''))) AS fp FROM events")
def h17(t):
    return t.events.select("event_id", text.fingerprint(F.col("user_id"), F.col("event_type"), F.col("props")).alias("fp"))


@query("h18_append_once", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'code' WHEN contains(url, 'example.com') THEN url ELSE concat(url, ' | ', 'example.com') END AS merged FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'code' ELSE url END AS url FROM pages)")
def h18(t):
    old = F.when(F.col("page_id") % 3 == 0, F.lit(None)).otherwise(F.col("url"))
    new = F.when(F.col("page_id") % 3 == 0, F.lit("code")).otherwise(F.lit("example.com"))
    return t.pages.select("page_id", text.append_once(old, new).alias("merged"))


@query("h19_slugify", f"SELECT doc_id, regexp_replace(regexp_replace({FOLD}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM {TITLES}")
def h19(t):
    return titles(t).select("doc_id", text.slugify(X()).alias("slug"))


@query("h20_codes", "SELECT ent, CASE ent % 5 WHEN 0 THEN 'Hard' WHEN 1 THEN 'Clay' WHEN 2 THEN 'Grass' WHEN 3 THEN 'Clay' ELSE 'Carpet' END AS surface, CASE WHEN ent % 2 = 0 THEN 'M15' ELSE 'M25' END AS category FROM v_ent")
def h20(t):
    code = F.element_at(F.array(*map(F.lit, ["IH", "C", "g", "Clay - Outdoor", "Carpet"])), (F.col("ent") % 5 + 1).cast("int"))
    return t.v_ent.select("ent", text.surface_of_code(code).alias("surface"), text.category_code(F.when(F.col("ent") % 2 == 0, "M15K").otherwise("m25+H")).alias("category"))


@query("h21_cut_token", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN cast(user_id AS INTEGER) WHEN 1 THEN cast(user_id AS INTEGER) END AS rnk, event_id % 4 = 0 AS foreign_rank, CASE event_id % 4 WHEN 2 THEN 'UR' END AS status FROM events")
def h21(t):
    k = F.col("event_id") % 4
    tok = text.cut_token(F.when(k == 0, F.concat(F.lit("*"), "user_id")).when(k == 1, F.col("user_id").cast("string")).when(k == 2, "ur").otherwise("wd?"))
    return t.events.select("event_id", tok.alias("z")).select("event_id", F.col("z.rank").alias("rnk"), F.col("z.foreign").alias("foreign_rank"), F.col("z.status").alias("status"))


@query("h22_json_arrays", "SELECT user_id, cast(max(cast(json_extract_string(props, '$.k') AS INTEGER)) AS INTEGER) AS k, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY user_id")
def h22(t):
    return t.events.groupBy("user_id").agg(F.max(F.get_json_object("props", "$.k").cast("int")).alias("k"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@query("h23_url_year", "SELECT page_id, cast(1994 + page_id % 4 AS INTEGER) IN (1996, 1995) AS ok FROM pages")
def h23(t):
    url = F.concat(F.lit("http://x/posting/"), F.lit(1994) + F.col("page_id") % 4, F.lit("/a.pdf"))
    return t.pages.select("page_id", text.url_year_matches(url, F.lit(1996)).alias("ok"))


RANK = "CASE WHEN level LIKE '%500%' THEN 80 WHEN level LIKE '%250%' THEN 70 WHEN level LIKE '%125' THEN 55 WHEN level LIKE '%75' THEN 45 ELSE 20 END"


@query("i01_i02_levels", f"SELECT ed_id, CASE WHEN level LIKE 'ITF%' THEN 'itf' WHEN level LIKE 'Ch%' THEN 'challenger' ELSE 'atp' END AS level_group, CASE WHEN level LIKE 'ITF%' THEN NULL WHEN level LIKE 'Ch%' THEN 'challenger' ELSE 'tour' END AS tier_group, CASE WHEN level LIKE 'ITF%' THEN 'itf' WHEN level LIKE 'Ch%' THEN 'challenger' ELSE 'tour' END AS category, {RANK} AS rnk FROM v_ed")
def i01(t):
    lv = F.col("level")
    return t.v_ed.select("ed_id", levels.level_group(lv).alias("level_group"), levels.tier_group(lv).alias("tier_group"), levels.category(lv).alias("category"), levels.level_rank(lv).alias("rnk"))


@query("i03_i05_slots", f"""SELECT ed_id, CASE WHEN r >= 70 THEN 2e0 WHEN r >= 35 THEN 1e0 ELSE 0.5e0 END AS weight,
 cast(CASE WHEN draw IS NOT NULL AND draw > res THEN draw - res WHEN r >= 70 THEN 24 WHEN r >= 35 THEN 25 ELSE 24 END AS INTEGER) AS slots, CASE WHEN draw IS NOT NULL AND draw > res THEN 'actual' ELSE 'default' END AS source,
 CASE WHEN r >= 80 THEN 24 WHEN r >= 70 THEN 26 ELSE 0 END * CASE ed_id % 4 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.5e0 WHEN 2 THEN 0.25e0 ELSE 0.0e0 END AS absorbed, 1 AS reach,
 CASE WHEN r <= 45 THEN 'high' WHEN r <= 60 THEN 'low' ELSE 'none' END AS exposure
FROM (SELECT ed_id, {RANK} AS r, CASE WHEN {RANK} >= 70 THEN 8 ELSE 7 END AS res, CASE WHEN ed_id % 3 = 0 THEN cast(ed_id % 64 AS INTEGER) END AS draw FROM v_ed)""")
def i03(t):
    lv, draw = F.col("level"), F.when(F.col("ed_id") % 3 == 0, (F.col("ed_id") % 64).cast("int"))
    s = levels.da_slots(lv, draw)
    return t.v_ed.select("ed_id", levels.supply_weight(lv).alias("weight"), s["slots"].alias("slots"), s["source"].alias("source"), levels.absorption_slots(lv, (F.col("ed_id") % 4).cast("int")).alias("absorbed"), levels.reach_weeks(lv).alias("reach"), levels.exposure(lv).alias("exposure"))


@query("i06_expected_draws", "SELECT ed_id, d.ev, d.dr FROM v_ed JOIN (VALUES ('singles','main'),('singles','qualifying'),('doubles','main'),('doubles','qualifying')) AS d(ev, dr) ON (level NOT LIKE 'ITF%' OR ev = 'singles') AND (d.ev <> 'doubles' OR d.dr = 'main' OR level = 'ATP 500')")
def i06(t):
    return basics.expected_draws(t.v_ed.select("ed_id", "level"))


@query("i08_surface_family", "SELECT ent, CASE WHEN ent % 4 = 0 THEN 'hard' ELSE lower(surface) END AS family, ent % 4 = 0 AS indoor FROM v_ent")
def i08(t):
    s = F.when(F.col("ent") % 4 == 0, F.lit("Carpet")).otherwise(F.col("surface"))
    return t.v_ent.select("ent", levels.surface_family(s).alias("family"), levels.is_indoor(s, F.lit(None).cast("boolean")).alias("indoor"))


@query("i09_neighbours", "WITH p AS (SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey % 5 < 4) SELECT a, b FROM p UNION SELECT b, a FROM p")
def i09(t):
    pairs = t.nation.where("n_nationkey % 5 < 4").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b"))
    return basics.both_ways(pairs, "a", "b")


@query("i09_countries", "WITH a AS (SELECT lower(n_name) AS alias, concat('Land ', n_nationkey) AS name FROM nation WHERE n_nationkey % 2 = 0), c AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN concat('land ', n_nationkey) ELSE lower(n_name) END AS country, r_name AS continent FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 > 0) SELECT ent, coalesce(a.name, v.country) AS shown, c.continent FROM v_ent v LEFT JOIN a ON a.alias = lower(v.country) LEFT JOIN c ON c.country = lower(coalesce(a.name, v.country))")
def i09c(t):
    n = F.col("n_nationkey")
    short = F.concat(F.lit("Land "), n.cast("string"))
    a = t.nation.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("alias"), short.alias("name"))  # every other country has a short name
    c = t.nation.where("n_nationkey % 5 > 0").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.when(n % 2 == 0, F.lower(short)).otherwise(F.lower("n_name")).alias("country"), F.col("r_name").alias("continent"))
    return basics.canonical_countries(t.v_ent.select("ent", "country"), "country", a, c).select("ent", "shown", "continent")


@query("i10_entry_codes", """WITH x AS (SELECT event_id, CASE user_id % 9 WHEN 0 THEN ' ng' WHEN 1 THEN 'JR' WHEN 2 THEN 'co' WHEN 3 THEN 'WC' WHEN 4 THEN 'SE' WHEN 5 THEN 'PR' WHEN 6 THEN 'q' WHEN 7 THEN 'ALT' ELSE 'ZZ' END AS code, CASE user_id % 4 WHEN 0 THEN 'CH 50' WHEN 1 THEN 'CH 100' WHEN 2 THEN 'CH 175' ELSE 'ATP 250' END AS level, CASE WHEN event_id % 7 > 0 THEN cast(floor(value) AS INTEGER) END AS rk FROM events), y AS (SELECT *, upper(trim(code)) AS c FROM x)
SELECT event_id, CASE c WHEN 'NG' THEN 'Next Gen Accelerator' WHEN 'JR' THEN 'Junior Accelerator — number is an ITF junior ranking' WHEN 'CO' THEN 'College Accelerator — number is an ITA collegiate ranking' WHEN 'WC' THEN 'Wild card' WHEN 'SE' THEN 'Special exempt' WHEN 'PR' THEN 'Protected ranking' WHEN 'Q' THEN 'Qualifier' WHEN 'ALT' THEN 'Alternate' END AS label, c IN ('JR', 'CO') AS is_foreign,
 CASE WHEN c = 'NG' THEN level IN ('CH 50', 'CH 75', 'CH 100', 'CH 125') WHEN c IN ('JR', 'CO') THEN level IN ('CH 50', 'CH 75') ELSE true END AS allowed, CASE WHEN c IN ('JR', 'CO') THEN c WHEN rk IS NULL THEN CASE WHEN c = 'ZZ' THEN '' ELSE c END ELSE concat_ws(' ', cast(rk AS VARCHAR), nullif(c, 'ZZ')) END AS shown FROM y""")
def i10(t):
    u = F.col("user_id") % 9
    code = F.get(F.array(*map(F.lit, (" ng", "JR", "co", "WC", "SE", "PR", "q", "ALT", "ZZ"))), u.cast("int"))
    level = F.get(F.array(*map(F.lit, ("CH 50", "CH 100", "CH 175", "ATP 250"))), (F.col("user_id") % 4).cast("int"))
    rows = t.events.select("event_id", code.alias("code"), level.alias("level"), F.when(F.col("event_id") % 7 > 0, F.floor("value").cast("int")).alias("rk"))
    return basics.entry_codes(rows, "code", "level", "rk").select("event_id", "label", F.col("foreign").alias("is_foreign"), "allowed", "shown")


@query("b01_b02_cuts", "SELECT ed_id, ev, dr, CASE WHEN ev = 'doubles' THEN coalesce(adv_rank, alt_rank, direct_rank) ELSE coalesce(alt_rank, direct_rank) END AS legacy, CASE WHEN ev = 'doubles' THEN coalesce(adv_rank, direct_rank) ELSE direct_rank END AS direct FROM v_snap")
def b01(t):
    ev, d, a, v = (F.col(c) for c in ("ev", "direct_rank", "alt_rank", "adv_rank"))
    return t.v_snap.select("ed_id", "ev", "dr", cuts.legacy_cut(ev, d, a, v).alias("legacy"), cuts.direct_cut(ev, d, v).alias("direct"))


@query("b03_valid_obs", "SELECT ed_id, ev, dr, cut FROM v_obs WHERE cut >= 3 AND level NOT LIKE 'ITF%' AND wk IS NOT NULL")
def b03(t):
    return basics.valid_observations(t.v_obs).select("ed_id", "ev", "dr", "cut")


@query("b04_in_season", "SELECT ed_id FROM v_ed WHERE yr + CASE WHEN start_date >= cast(date_trunc('week', make_date(yr + 1, 1, 5)) AS DATE) - 7 THEN 1 ELSE 0 END = 1996 OR (level LIKE 'ITF%' AND yr = 1996)")
def b04(t):
    return t.v_ed.where(dates.in_season(F.col("start_date"), F.lit(1996), F.col("level"))).select("ed_id")


@query("b05_b06_presence", "SELECT ed_id, ev, dr, coalesce(byes, 0) > 0 AND coalesce(direct_rank, alt_rank, adv_rank) IS NULL AS open_draw, coalesce(direct_rank, alt_rank, adv_rank, byes) IS NOT NULL AS has_cut, cut IS NULL OR cut > CASE WHEN ev = 'doubles' THEN 500 ELSE 600 END AS saturated FROM v_obs")
def b05(t):
    r = [F.col(c) for c in ("direct_rank", "alt_rank", "adv_rank")]
    return t.v_obs.select("ed_id", "ev", "dr", cuts.open_draw(F.col("byes"), *r).alias("open_draw"), cuts.has_cut(F.col("byes"), *r).alias("has_cut"), cuts.saturated(F.col("cut"), F.col("ev")).alias("saturated"))


_NAME = "CASE ed_id % 20 WHEN 0 THEN '62 75' WHEN 1 THEN 'PRIZE MONEY 5' WHEN 2 THEN 'First Round' WHEN 3 THEN 'Seeded Players' WHEN 4 THEN 'Challenger Supervisor' WHEN 5 THEN 'Roma Open 3' WHEN 6 THEN 'wc' WHEN 7 THEN 'D+D 88' WHEN 8 THEN 'Semi-Finalist 2' WHEN 9 THEN '44' WHEN 10 THEN '$ 40' WHEN 11 THEN 'Last Direct Acceptance X' WHEN 12 THEN NULL ELSE 'J. Player' END"


@query("b07_garbage", f"""WITH x AS (SELECT *, {_NAME} AS name, ed_id % 13 = 0 AS manual, CASE WHEN ed_id % 17 = 0 THEN 2 WHEN ed_id % 19 = 0 THEN 6000 WHEN ed_id % 20 = 12 THEN 1998 ELSE direct_rank END AS r FROM v_snap), g AS (SELECT ed_id, ev, dr, CASE WHEN manual OR adv_rank IS NOT NULL THEN NULL WHEN r BETWEEN 1900 AND 2100 AND NOT regexp_matches(coalesce(name, ''), '[A-Za-z]') THEN 'year' WHEN r > 5000 THEN 'too high' WHEN r < 3 THEN 'too low' WHEN regexp_matches(name, '^[ ]*[0-9]+[ ]*$') THEN 'digits' WHEN contains(name, '$') THEN 'currency' WHEN name ILIKE '%prize money%' THEN 'prize money' WHEN name ILIKE '%first round%' THEN 'first round' WHEN name ILIKE '%seeded players%' THEN 'seeded'
 WHEN name ILIKE '%challenger supervisor%' THEN 'supervisor' WHEN name ILIKE '% open %' THEN 'open' WHEN name ILIKE '%semi-finalist%' THEN 'finalist' WHEN name ILIKE 'last direct acceptance%' THEN 'label' WHEN contains(name, 'D+D') THEN 'combined' WHEN lower(name) = 'wc' THEN 'code' WHEN name = '62 75' THEN 'score' END AS rule FROM x) SELECT * FROM g WHERE rule IS NOT NULL""")
def b07(t):
    k = F.col("ed_id")
    name = F.expr(_NAME)
    rank = F.when(k % 17 == 0, 2).when(k % 19 == 0, 6000).when(k % 20 == 12, 1998).otherwise(F.col("direct_rank"))
    return t.v_snap.withColumn("rule", cuts.garbage(rank, name, k % 13 == 0, F.col("adv_rank"))).where("rule is not null").select("ed_id", "ev", "dr", "rule")


MINP = "CASE WHEN dr = 'qualifying' THEN 30 WHEN level LIKE '%500%' THEN CASE WHEN ev = 'doubles' THEN 20 ELSE 15 END WHEN level LIKE '%250%' THEN CASE WHEN ev = 'doubles' THEN 20 ELSE 10 END WHEN level LIKE 'Ch%' THEN 50 ELSE 5 END"


@query("b08_min_plausible", f"SELECT ed_id, ev, dr, cut, {MINP} AS least, concat_ws(' | ', 'checked', concat('[below ', {MINP}, ']')) AS notes FROM v_obs WHERE cut < {MINP}")
def b08(t):
    least = cuts.min_plausible(F.col("level"), F.col("ev"), F.col("dr"))
    x = t.v_obs.withColumn("least", least).where("cut < least").withColumn("tag", F.concat(F.lit("[below "), "least", F.lit("]")))
    once = text.append_once(F.lit("checked"), F.col("tag"))
    return x.select("ed_id", "ev", "dr", "cut", "least", text.append_once(once, F.col("tag")).alias("notes"))


@query("b09_search", "SELECT ent, city FROM (SELECT *, abs(cast(bal AS INTEGER)) AS far FROM v_ent WHERE contains(lower(city), 'ion')) ORDER BY far, ent LIMIT 25")
def b09(t):
    return basics.search(t.v_ent, "city", "  Ion ", F.abs(F.rint("bal").cast("int")), "ent").select("ent", "city")


@query("b10_all_words", "SELECT ent FROM v_ent WHERE contains(lower(concat(city, ' ', region)), 'am') AND contains(lower(concat(city, ' ', region)), '1')")
def b10(t):
    return basics.match_all_words(t.v_ent, F.concat("city", F.lit(" "), "region"), "AM 1").select("ent")


@query("b11_facets", "SELECT surface, count(*) AS n FROM v_ent WHERE surface IN ('Clay', 'Hard') AND region LIKE 'A%' GROUP BY surface")
def b11(t):
    return basics.facet_counts(t.v_ent.where(F.col("region").startswith("A")), "surface", ["Clay", "Hard"])


@query("b12_below_threshold", "SELECT ed_id, ev, dr, src, rnk FROM (SELECT ed_id, ev, dr, 'direct_rank' AS src, direct_rank AS rnk FROM v_snap UNION ALL SELECT ed_id, ev, dr, 'alt_rank', alt_rank FROM v_snap UNION ALL SELECT ed_id, ev, dr, 'adv_rank', adv_rank FROM v_snap) WHERE rnk < 40")
def b12(t):
    return basics.below_threshold(t.v_snap, ["ed_id", "ev", "dr"], ["direct_rank", "alt_rank", "adv_rank"], 40)
