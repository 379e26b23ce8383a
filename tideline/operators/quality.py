"""Audits, duplicates and the case ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import cuts, dates, levels, text
from tideline.operators import windows
from tideline.operators.containment import contains_any
from tideline.operators.joins import pick
from tideline.storage import materialise


def same_week_duplicates(df: DataFrame, week: list[str], keys: list[str]) -> DataFrame:
    """Groups of two or more editions of one week that share any of the place keys; each member set once."""
    tagged = df.withColumn("place", F.explode(F.array_distinct(F.array(*keys)))).where("place <> ''")
    groups = tagged.groupBy(*week, "place").agg(F.array_sort(F.collect_set("ed_id")).alias("ids")).where(F.size("ids") >= 2)
    return groups.groupBy(*week, "ids").agg(F.min("place").alias("place")).withColumn("members", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).drop("ids")


def duplicate_pairs(df: DataFrame) -> DataFrame:
    """``a, b``: pairs of one week and category (not ITF or unknown) that name the same event: one name contains the other in the same
    country, or the city is the same, or a place key of city or name is shared. ``df`` has ed_id, yr, wk, level, name, city, country."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\([^)]*\)", ""), "[^a-z0-9]", "")
    e = df.withColumn("category", levels.category(F.col("level"))).where("category <> 'itf'")
    places = F.filter(F.array_distinct(F.array(text.place_key(F.col("city")), text.place_key(F.col("name")))), lambda p: p != "")
    e = e.select("ed_id", "yr", "wk", "category", plain(F.col("name")).alias("name"), plain(F.col("city")).alias("city"), plain(F.col("country")).alias("country"), places.alias("places"))
    week = ["yr", "wk", "category"]

    def pairs(rows: DataFrame, on: str, keep: list[str]) -> DataFrame:
        a = rows.select(*week, on, F.col("ed_id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in keep))
        b = rows.select(*week, on, F.col("ed_id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in keep))
        return a.join(b, [*week, on]).where("a < b")

    inside = (F.col("a_name") != "") & (F.col("b_name") != "") & (F.contains("a_name", "b_name") | F.contains("b_name", "a_name"))
    named = pairs(e, "country", ["name"]).where(inside).select("a", "b")
    city = pairs(e.where("city <> ''"), "city", []).select("a", "b")
    place = pairs(e.withColumn("place", F.explode("places")), "place", []).select("a", "b")
    return named.unionByName(city).unionByName(place).distinct()


def code_winners(df: DataFrame, editions: DataFrame, skip: list[str] | None = None, min_days: int = 14) -> DataFrame:
    """``code, ent, winner, action``: entities that share a code with a better one. ``df`` has code, ent, slug, name, canonical.

    The winner has the best score: canonical +1000, no part 'ch' +50, a doubled slug (x-x) -200, less its length. A ghost is left alone if
    it and the winner have editions of one year ``min_days`` or more apart, or different numbers. Codes in ``skip`` are left out.
    """
    d = df.where(~F.col("code").isin(skip or [])).dropDuplicates(["code", "ent"])
    half = F.floor(F.length("slug") / 2).cast("int")
    doubled = (F.length("slug") % 2 == 1) & (F.substr("slug", F.lit(1), half) == F.substr("slug", half + 2, half)) & (F.substr("slug", half + 1, F.lit(1)) == "-")
    score = F.when(F.col("canonical"), 1000).otherwise(0) + F.when(F.col("slug").rlike(r"\bch\b"), 0).otherwise(50) - F.when(doubled, 200).otherwise(0) - F.length("slug")
    n = d.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("code")
    number = F.coalesce(F.nullif(F.regexp_extract("name", r"\s(\d+)\s*(?:\(|$)", 1), F.lit("")), F.nullif(F.regexp_extract("slug", r"-(\d+)(?:-|$)", 1), F.lit("")))
    scored = d.join(n, "code").withColumn("score", score).withColumn("number", number)
    best = pick(scored, ["code"], [F.col("score").desc(), F.col("ent")]).select("code", F.col("ent").alias("winner"), F.col("number").alias("w_number"))
    ghosts = scored.join(best, "code").where("ent <> winner")
    own, other = editions.select("ent", "yr", F.col("start_date").alias("d1")), editions.select(F.col("ent").alias("winner"), "yr", F.col("start_date").alias("d2"))
    far = ghosts.select("ent", "winner").distinct().join(own, "ent").join(other, ["winner", "yr"]).groupBy("ent", "winner").agg(F.bool_or(F.abs(F.datediff("d1", "d2")) >= min_days).alias("far"))
    got = ghosts.join(far, ["ent", "winner"], "left")
    apart = F.coalesce(F.col("far"), F.lit(False)) | F.coalesce(F.col("number") != F.col("w_number"), F.lit(False))
    return got.select("code", "ent", "winner", F.when(apart, "distinct").otherwise("merge").alias("action"))


def blocked_merges(pairs: DataFrame) -> DataFrame:
    """The first reason that blocks the merge of a ghost into a canonical row, null if none: another country (unless the ghost has none),
    a name that is neither the canonical one's name nor its city, or level kinds that do not agree. Pairs have country_, name_, city_
    and kinds_ (arrays of atp, challenger, other) for canonical and ghost, with the suffixes c and g."""
    key = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text.fold(F.col(c)), r",\s*[a-z]{2}$", ""), "[-_]+", " "), r"\s+", " "))
    has = lambda c, kind: F.array_contains(f"kinds_{c}", kind)
    country = F.col("country_g").isNotNull() & ~F.col("country_g").eqNullSafe(F.col("country_c"))
    name = (key("name_g") != key("name_c")) & (key("name_g") != key("city_c"))
    level = (has("g", "challenger") & has("c", "challenger") & ~has("c", "atp")) | (has("g", "atp") & has("c", "atp") & ~has("c", "challenger"))
    return pairs.withColumn("blocked", F.when(country, "country").when(name, "name").when(~level, "level"))


def due_draws(editions: DataFrame, grace: int = 3, lead: int = 0) -> DataFrame:
    """``ed_id, draw, closed, due``: the draws that should have a cut (ITF is not covered). A cut is due ``lead`` days before the start, and no
    sooner than ``grace`` days after the entry deadline. Slam qualifying stands alone and closes 21 days before its Monday."""
    from tideline.plans.field import deadlines

    names = F.create_map(*(F.lit(x) for x in ("main", "singles-main", "qualifying", "singles-qualifying", "doubles", "doubles-main")))
    d = deadlines(editions).where("category <> 'itf' and not (category = 'slam' and kind = 'qualifying')")
    rows = d.select("ed_id", names[F.col("kind")].alias("draw"), F.to_date("due_at").alias("closed"))
    alone = editions.where(levels.is_slam_qualifying(F.col("level"))).select("ed_id", F.lit("singles-qualifying").alias("draw"), F.date_sub(dates.monday_of(F.col("start_date")), 21).alias("closed"))
    start = editions.select("ed_id", "start_date")
    return rows.unionByName(alone).join(start, "ed_id").select("ed_id", "draw", "closed", F.greatest(F.date_add("closed", grace), F.date_sub("start_date", lead)).alias("due"))


#: The largest rank that a cut can have.
MAX_CUT = {"singles": 2500, "doubles": 6000}


def audit(editions: DataFrame, snaps: DataFrame, as_of: Column, weeks: int = 2) -> DataFrame:
    """``rule, severity, ed_id``. Editions have ed_id, ent, yr, wk, level, surface, start_date, end_date; snaps ed_id, ev, dr, direct_rank, byes, written
    and, where known, adv_rank and onsite_rank.

    C1 impossible ranks (of doubles the advanced and on-site ones too; ITF is not tracked), C2 qualifying better than main, C7 stored week, C9 cut far from the event's own history, C10 changed surface, C12
    start after Tuesday or a length outside 0 to 13 days (1000s exempt). Coverage of covered draws that are due: A1 nothing at all
    (from last week to the end of the window), then, for events of the next 60 days that A1 does not name, A2 singles main, A3 doubles
    and A4 qualifying (both with a singles main cut); A5 a cut last written before its list closed. S1 counts the due draws of the
    window without a cut, one row for each (informational).
    """
    find = lambda df, rule, sev: df.select(F.lit(rule).alias("rule"), F.lit(sev).alias("severity"), "ed_id").distinct()
    tour = ~levels.category(F.col("level")).eqNullSafe(F.lit("itf")) & levels.category(F.col("level")).isNotNull()
    editions, snaps = materialise(editions, "audited-editions"), materialise(snaps, "audited-snaps")  # every check reads them
    s = snaps.join(editions.select("ed_id", "level"), "ed_id")
    doubles = F.col("ev") == "doubles"
    ranks = F.array(F.col("direct_rank"), *(F.when(doubles, F.col(c)) for c in ("adv_rank", "onsite_rank") if c in snaps.columns))
    least, most = cuts.min_plausible(F.col("level"), F.col("ev"), F.col("dr")), F.when(doubles, MAX_CUT["doubles"]).otherwise(MAX_CUT["singles"])
    c1 = s.where(~levels.category(F.col("level")).eqNullSafe(F.lit("itf")) & F.exists(ranks, lambda v: (v < least) | (v > most)))
    sides = lambda d: F.max(F.when((F.col("ev") == "singles") & (F.col("dr") == d), F.col("direct_rank")))
    c2 = s.where(tour).groupBy("ed_id").agg(sides("main").alias("m"), sides("qualifying").alias("q")).where("q < m")
    c7 = editions.where(~F.col("wk").eqNullSafe(dates.season_week(F.col("start_date"), F.col("yr"))))
    cut = snaps.where("ev = 'singles' and dr = 'main' and direct_rank is not null").select("ed_id", "direct_rank")
    c9 = windows.history_outlier(editions.where(tour).join(cut, "ed_id"), ["ent", "level"], "yr", "direct_rank")
    bare = F.regexp_replace(F.lower("surface"), "indoor|outdoor|[^a-z]", "")
    c10 = windows.changed_since_last(editions.where(tour & F.col("surface").isNotNull()).withColumn("bare", bare), "ent", "yr", "bare")
    days = F.datediff("end_date", "start_date")
    late = F.weekday("start_date").between(2, 5) | F.coalesce((days < 0) | (days > 13), F.lit(False))
    c12 = editions.where(tour & ~F.contains("level", F.lit("1000")) & late)

    week = dates.monday_of(as_of)
    draw = F.concat_ws("-", "ev", "dr")
    have = snaps.where("direct_rank is not null or byes is not null").select("ed_id", draw.alias("draw"), "written")
    due = due_draws(editions.where(F.col("start_date") >= F.date_sub(week, 7))).join(editions.select("ed_id", "start_date"), "ed_id").join(have.groupBy("ed_id", "draw").agg(F.max("written").alias("written"), F.lit(True).alias("has")), ["ed_id", "draw"], "left")
    due = materialise(due, "audited-draws")
    over, missing = F.col("due") < as_of, F.col("has").isNull()
    recent = F.col("start_date") >= F.date_sub(week, 7)
    ends = F.date_add(week, 7 * weeks)
    a1 = due.where(recent & (F.col("start_date") < ends)).groupBy("ed_id").agg(F.bool_or(over).alias("over"), F.count("has").alias("n")).where("over and n = 0").join(have.select("ed_id"), "ed_id", "left_anti")
    open_ = due.where(recent & (F.col("start_date") < F.date_add(week, 60)) & over & missing).join(a1.select("ed_id"), "ed_id", "left_anti")
    with_main = open_.join(cut.select("ed_id"), "ed_id", "left_semi")
    slam = editions.where(levels.category(F.col("level")) == "slam").select("ed_id")
    a5 = due.where(recent & (F.col("start_date") < F.date_add(week, 45)) & over & (F.col("written") < F.col("closed")))
    s1 = due.where((F.col("start_date") >= week) & (F.col("start_date") < ends) & over & missing)
    parts = [
        find(c1, "C1", "critical"), find(c2, "C2", "critical"), find(c7, "C7", "warn"), find(c9, "C9", "warn"), find(c10, "C10", "warn"), find(c12, "C12", "warn"),
        find(a1, "A1", "critical"), find(open_.where("draw = 'singles-main'"), "A2", "critical"), find(with_main.where("draw = 'doubles-main'"), "A3", "critical"),
        find(with_main.where("draw = 'singles-qualifying'").join(slam, "ed_id", "left_anti"), "A4", "warn"), find(a5, "A5", "warn"), find(s1, "S1", "info"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reduce_severity(findings: DataFrame, acknowledged: DataFrame, by: list[str], as_of: Column) -> DataFrame:
    """The worst severity of active findings; acknowledged ones don't count until their expiry."""
    quiet = acknowledged.where(F.col("until") > as_of).select("rule", "ed_id")
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warn", 1).otherwise(0)
    return findings.join(quiet, ["rule", "ed_id"], "left_anti").groupBy(*by).agg(F.max(rank).alias("worst"), F.count(F.lit(1)).alias("n"))


def liveness(events: DataFrame, by: str, ts: str, as_of: Column) -> DataFrame:
    """Writes in 7 and 30 days and the age of the newest."""
    age = F.datediff(as_of, F.to_date(ts))
    return events.groupBy(by).agg(F.count(F.when(age < 7, 1)).alias("week"), F.count(F.when(age < 30, 1)).alias("month"), F.min(age).alias("age"))


def forward_gaps(editions: DataFrame, as_of: Column, weeks: int = 8, few: int = 4) -> DataFrame:
    """The next weeks without (critical) or with few (warn) events; weeks from 18 December on are thin by nature and only empty ones count."""
    spine = editions.sparkSession.range(weeks).select(F.expr("cast(id as int)").alias("k")).withColumn("week", F.date_add(dates.monday_of(as_of), F.col("k") * 7))
    n = editions.groupBy(dates.monday_of(F.col("start_date")).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    got = spine.join(n, "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("n"))
    holiday = (F.month("week") == 12) & (F.dayofmonth("week") >= 18)
    return got.withColumn("severity", F.when(F.col("n") == 0, "critical").when((F.col("n") < few) & ~holiday, "warn").otherwise("ok"))


#: States of a case that is not closed.
OPEN_STATES = ["open", "in_progress", "escalated"]


def sync_ledger(cases: DataFrame, findings: DataFrame, ran: list[str], now: Column, verified: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The case table after a run and its log. Cases have key, rule, status, times_seen, attempts; findings key, rule.

    New findings open; fixed ones that come back reopen with no attempts; open ones seen again count up; open ones that are gone are
    fixed if their check ran or their key is among the ``verified`` (what a sampled check looked at and found right).
    """
    a = cases.select("key", F.col("rule").alias("_r"), "status", "times_seen", "attempts", F.lit(True).alias("_a"))
    b = findings.select("key", F.col("rule").alias("_f"), F.lit(True).alias("_b")).dropDuplicates(["key"])
    both = a.join(b, "key", "full_outer").withColumn("rule", F.coalesce("_r", "_f"))
    if verified is None:
        both = both.withColumn("_v", F.lit(False))
    else:
        both = both.join(verified.select("key", F.lit(True).alias("_v")).dropDuplicates(["key"]), "key", "left")
    new, seen, fixed = F.col("_a").isNull(), F.col("_b").isNotNull(), F.col("status") == "fixed"
    gone = F.col("status").isin(OPEN_STATES) & (F.col("rule").isin(ran) | F.coalesce("_v", F.lit(False)))
    event = F.when(new, "opened").when(seen & fixed, "reopened").when(seen, "seen").when(gone, "fixed")
    tagged = both.withColumn("event", event)
    status = F.when(F.col("event").isin("opened", "reopened"), "open").when(F.col("event") == "fixed", "fixed").otherwise(F.col("status"))
    times = F.coalesce("times_seen", F.lit(0)) + F.when(seen, 1).otherwise(0)
    attempts = F.when(F.col("event").isin("opened", "reopened"), 0).otherwise(F.col("attempts"))
    state = tagged.select("key", "rule", status.alias("status"), times.alias("times_seen"), attempts.alias("attempts"))
    return state, tagged.where("event is not null").select("key", "rule", "event", now.alias("at"))


def ledger_counts(cases: DataFrame, max_attempts: int = 2) -> DataFrame:
    """Cases by status, and those out of attempts."""
    return cases.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("attempts") >= max_attempts, 1)).alias("exhausted"))


def worst_first(cases: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` cases: escalated, open, in progress, closed; critical first; newest id first."""
    state = F.when(F.col("status") == "escalated", 0).when(F.col("status") == "open", 1).when(F.col("status") == "in_progress", 2).otherwise(3)
    return cases.orderBy(state, F.when(F.col("severity") == "critical", 0).otherwise(1), F.col("id").desc()).limit(limit)


def ledger_actions(cases: DataFrame, now: Column, max_attempts: int = 2, reminder_days: int = 7, fixed_days: int = 7) -> DataFrame:
    """``id, action``: work (open with attempts left), escalate (out of attempts), tell (escalated, never told), remind (told more than
    ``reminder_days`` ago), recent (fixed in the last ``fixed_days``). Cases have id, status, attempts, notified_at, resolved_at."""
    live = F.col("status").isin("open", "in_progress")
    told = F.col("notified_at") < now - F.expr(f"interval {reminder_days} days")
    recent = (F.col("status") == "fixed") & (F.col("resolved_at") > now - F.expr(f"interval {fixed_days} days"))
    up = F.col("status") == "escalated"
    action = F.when(live & (F.col("attempts") < max_attempts), "work").when(live, "escalate").when(up & F.col("notified_at").isNull(), "tell").when(up & told, "remind").when(recent, "recent")
    return cases.select("id", action.alias("action")).where("action is not null")


def adds_up(df: DataFrame, parts: list[str], total: str) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + F.coalesce(p, F.lit(0))
    return out == F.col(total)


#: The only level with doubles qualifying, and the exhibitions whose rows are no events.
DOUBLES_QUALIFYING_LEVEL, EXHIBITIONS = "ATP 500", ["united-cup"]


def invalid_combos(snaps: DataFrame, editions: DataFrame, exhibitions: list[str] | None = None) -> DataFrame:
    """``ed_id, problem``: editions with doubles qualifying outside the one level that has it, and rows of exhibitions, by the start of the slug or the
    whole name. ``editions`` has ed_id, level, slug, name; ``snaps`` ed_id, ev, dr."""
    bad = snaps.where("ev = 'doubles' and dr = 'qualifying'").join(editions.where(F.col("level") != DOUBLES_QUALIFYING_LEVEL), "ed_id").select("ed_id", F.lit("doubles qualifying").alias("problem"))
    shown = F.lit(False)
    for slug in exhibitions or EXHIBITIONS:
        shown = shown | F.col("slug").startswith(slug) | (F.trim(F.regexp_replace(text.fold(F.col("name")), "[^a-z0-9]+", " ")) == slug.replace("-", " "))
    return bad.distinct().unionByName(editions.where(shown).select("ed_id", F.lit("exhibition").alias("problem")))


def wrong_source_year(pairs: DataFrame) -> DataFrame:
    """Of two equal rows of consecutive years: keep the one whose URL has its year; neither: drop both; both: keep both."""
    verdict = F.when(F.col("ok_old") & F.col("ok_new"), "keep both").when(F.col("ok_old"), "drop new").when(F.col("ok_new"), "drop old").otherwise("drop both")
    return pairs.withColumn("verdict", verdict)


#: Where the official calendar comes from; such rows are right before any cut arrives.
OFFICIAL_SOURCE, OFFICIAL_URLS = "atp_official_calendar_pdf", ["atppz.com", "/calendar-pdfs/"]


def sweep_status(editions: DataFrame, canonical: DataFrame, season: int, discontinued: DataFrame, cancelled: DataFrame, cut_ids: DataFrame) -> DataFrame:
    """``ed_id, status, reason``: the status of each edition after the sweeps, in their order.

    stale: held rows of ``season`` whose slug is not canonical, without cuts, not ITF and not of the official calendar. discontinued: held rows, not ITF,
    of a year after ``final_year`` whose slug or name contains the rule's ``pattern``. cancelled: the same for the rule's ``year``, in the city too.
    Cuts do not protect from these two. restored: rows that were not held before but have cuts are held again.

    ``editions`` has ed_id, yr, level, slug, name, city, status, source, source_url. Patterns find their rows through the letters they are
    made of, ignoring case; no row is compared with every rule.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    e = editions.join(canonical.select("slug", F.lit(True).alias("_known")).distinct(), "slug", "left").join(cut_ids.select("ed_id", F.lit(True).alias("_cuts")).distinct(), "ed_id", "left")
    e = materialise(e.withColumn("_itf", low("level").startswith("itf")), "sweep")
    official = F.coalesce(F.col("source") == OFFICIAL_SOURCE, F.lit(False))
    for part in OFFICIAL_URLS:
        official = official | F.contains(low("source_url"), F.lit(part))
    live = e.where((F.col("status") == "held") & ~F.col("_itf"))
    gone = contains_any(live, ["slug", "name"], discontinued, "pattern").where(F.col("yr") > F.col("final_year")).select("ed_id", F.lit(True).alias("_gone")).distinct()
    off = contains_any(live, ["slug", "name", "city"], cancelled, "pattern").where(F.col("yr") == F.col("year")).select("ed_id", F.lit(True).alias("_off")).distinct()
    both = e.join(gone, "ed_id", "left").join(off, "ed_id", "left")
    held = F.col("status") == "held"
    stale = held & (F.col("yr") == season) & F.col("_known").isNull() & ~F.col("_itf") & F.col("_cuts").isNull() & ~official
    reason = F.when(stale, "stale").when(held & F.col("_gone"), "discontinued").when(held & F.col("_off"), "cancelled").when((F.col("status") == "not_held") & F.col("_cuts"), "restored")
    status = F.when(reason == "restored", "held").when(reason.isNotNull(), "not_held").otherwise(F.col("status"))
    return both.select("ed_id", status.alias("status"), reason.alias("reason"))


def audit_levels(editions: DataFrame, headers: DataFrame) -> DataFrame:
    """``ed_id, verdict``: missing code, unverifiable (no header of the edition's code and season), confirmed or mismatch. A heuristic header only
    contradicts a level that is no tour level; another must give the level exactly. ``headers`` has code, season, level, heuristic, one row
    for a code and season."""
    h = headers.select("code", F.col("season").alias("yr"), F.col("level").alias("_l"), "heuristic")
    tour = F.col("level").rlike(r"^ATP [0-9]+")
    right = F.when(F.col("heuristic"), tour).otherwise(F.col("_l") == F.col("level"))
    verdict = F.when(F.col("code").isNull(), "missing code").when(F.col("_l").isNull(), "unverifiable").when(right, "confirmed").otherwise("mismatch")
    return editions.join(h, ["code", "yr"], "left").select("ed_id", verdict.alias("verdict"))


def completeness_gate(df: DataFrame, batch: str, group: str, least: int) -> DataFrame:
    """Rows of batches with at least ``least`` groups; smaller batches are refused whole."""
    good = df.groupBy(batch).agg(F.count_distinct(group).alias("_n")).where(F.col("_n") >= least).select(batch)
    return df.join(good, batch, "left_semi")


def alert_liveness(subscribers: DataFrame, deadlines: DataFrame, sends: DataFrame, as_of: Column) -> DataFrame:
    """Categories with subscribers and passed deadlines but no send at all are critical."""
    subs = subscribers.groupBy("category").agg(F.count(F.lit(1)).alias("subscribers"))
    passed = deadlines.where(F.col("due") < as_of).groupBy("category").agg(F.count(F.lit(1)).alias("passed"))
    sent = sends.groupBy("category").agg(F.count(F.lit(1)).alias("sent"))
    both = subs.join(passed, "category").join(sent, "category", "left").withColumn("sent", F.coalesce("sent", F.lit(0)))
    return both.withColumn("severity", F.when(F.col("sent") == 0, "critical").otherwise("ok"))
