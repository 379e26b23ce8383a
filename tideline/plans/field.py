"""Competitive depth, field strength, drain, calendars and deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import dates, levels, text
from tideline.functions.geo import half_up, haversine_km, region_label, w_geo
from tideline.operators import joins, nearby
from tideline.storage import materialise


def _optional(events: DataFrame, column: str, kind: str) -> Column:
    return F.col(column) if column in events.columns else F.lit(None).cast(kind)


#: What tells events apart for their neighbours: those of one such group count alike.
ALIKE = ["yr", "wk", "rank", "family", "inside", "lat", "lon"]


def _competitors(events: DataFrame, discipline: str) -> DataFrame:
    """``events`` with rank, own slots, surface family, ``inside``, ``placed`` (takes part at all) and ``source`` (counts for others)."""
    lv = F.col("level")
    slots = levels.da_slots(lv, _optional(events, "draw_size", "int"), discipline)["slots"]
    e = events.select("*", levels.level_rank(lv).alias("rank"), levels.surface_family(F.col("surface")).alias("family"), levels.is_indoor(F.col("surface"), _optional(events, "indoor", "boolean")).alias("inside"))
    e = e.withColumn("own", F.when(F.col("rank") > 0, slots).otherwise(0)).withColumn("placed", (F.col("rank") > 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return e.withColumn("source", F.col("placed") & ~levels.is_slam_qualifying(lv))


def _raw_slots(offset: Column, discipline: str) -> Column:
    """Absorption above the Challenger stack (rank 60), own slots in it and below."""
    return F.when(F.col("rank") > 60, levels.absorption_slots(F.col("level"), offset, discipline)).otherwise(F.col("own").cast("double"))


def _in_scope(competitors: DataFrame, discipline: str) -> DataFrame:
    """The sources in each week that they reach, with ``at`` and ``raw``."""
    reach = joins.span_scope(competitors.where("source").withColumn("_span", levels.reach_weeks(F.col("level"))), "wk", "_span", "at")
    return reach.withColumn("raw", _raw_slots(F.col("at") - F.col("wk"), discipline)).where("raw <> 0")


def _weight(a: str, b: str) -> Column:
    km = haversine_km(F.col(f"{a}lat"), F.col(f"{a}lon"), F.col(f"{b}lat"), F.col(f"{b}lon"))
    return w_geo(km) * levels.w_surface(F.col(f"{a}family"), F.col(f"{b}family"), F.col(f"{a}inside"), F.col(f"{b}inside"))


def _surface_factors(spark: SparkSession) -> dict[tuple, float]:
    """The weight of each two kinds (family|inside)."""
    side = lambda s: spark.createDataFrame([(f, i) for f in levels.FAMILIES for i in (False, True)], f"{s}family string, {s}inside boolean")
    kind = lambda s: F.concat_ws("|", f"{s}family", F.col(f"{s}inside").cast("string")).alias(f"{s}kind")
    rows = side("").crossJoin(side("o_")).select(kind(""), kind("o_"), levels.w_surface(F.col("family"), F.col("o_family"), F.col("inside"), F.col("o_inside")).alias("w")).collect()  # 36 rows
    return {(r["kind"], r["o_kind"]): r["w"] for r in rows}


def depth(events: DataFrame, discipline: str = "singles") -> DataFrame:
    """``ed_id, own, others, depth``: own slots plus the weighted slots of others in the same week and of at least the same rank.

    Others above the Challenger stack count with what they absorb, decayed over the weeks that they reach; slam qualifying is
    inside the slam's figure and does not count. Events of an unknown level or without coordinates have their own slots
    only. ``indoor`` and ``draw_size`` are used where there are such columns. A week's distinct places are weighed against each other
    once, for all groups of events that count alike (place, rank, surface).
    """
    e = materialise(_competitors(events, discipline).select("ed_id", *ALIKE, "level", "own", "placed", "source"), "competitors")  # read for groups, sources and totals
    kind = F.concat_ws("|", "family", F.col("inside").cast("string")).alias("kind")
    others = _in_scope(e, discipline).groupBy("yr", F.col("at").alias("wk"), "rank", kind, "lat", "lon").agg(F.sum("raw").alias("raw"))
    groups = e.where("placed").select("yr", "wk", "rank", kind, "lat", "lon").distinct()
    sums = nearby.ranked_sums(groups, others, ["yr", "wk"], _surface_factors(events.sparkSession))
    e = e.withColumn("kind", kind)
    self_share = F.when(F.col("source"), _raw_slots(F.lit(0), discipline)).otherwise(0.0)  # an event is in its own group's sum
    total = e.join(sums, ["yr", "wk", "rank", "kind", "lat", "lon"], "left").select("ed_id", "own", F.when(F.col("placed"), F.coalesce("every", F.lit(0.0)) - self_share).otherwise(0.0).alias("others"))
    return total.withColumn("depth", F.col("own") + F.col("others"))


def contributions(events: DataFrame, discipline: str = "singles") -> DataFrame:
    """``ed_id, other, kind, km, contribution`` for each pair that adds to a depth. For the events of a few weeks: pairs are made."""
    e = _competitors(events, discipline)
    o = _in_scope(e, discipline).select("yr", F.col("at").alias("wk"), F.col("ed_id").alias("other"), "raw", *(F.col(c).alias(f"o_{c}") for c in ALIKE[2:]))
    pairs = e.where("placed").join(o, ["yr", "wk"]).where("o_rank >= rank and ed_id <> other")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
    return pairs.select("ed_id", "other", F.when(F.col("o_rank") > 60, "absorption").otherwise("peer").alias("kind"), km.alias("km"), (F.col("raw") * _weight("", "o_")).alias("contribution"))


def drain(events: DataFrame, km: float = 1500, places: int = 24) -> DataFrame:
    """``ed_id, nearby, places, exposure``: lower-tier events in the same week within ``km``."""
    spot = ["yr", "wk", "lat", "lon"]  # events of one spot have the same ones around; those of one place are counted first
    e = materialise(events.select("ed_id", *spot, "level"), "drained")
    low = e.where(F.col("level").startswith("ITF")).groupBy(*spot).agg(F.count(F.lit(1)).alias("n"))
    asked = e.where(~F.col("level").startswith("ITF")).select(*spot).distinct()
    near = joins.near_in_time_space(asked, low, ["yr"], "wk", [0], km).groupBy(*spot).agg(F.sum("r_n").alias("nearby"))
    n = F.coalesce("nearby", F.lit(0))
    return e.where(~F.col("level").startswith("ITF")).join(near, spot, "left").select("ed_id", n.alias("nearby"), (n * places).alias("places"), levels.exposure(F.col("level")).alias("exposure"))


def strength(calendar: DataFrame, obs: DataFrame, projections: DataFrame, year: int, min_n: int = 8) -> DataFrame:
    """Field strength of a season's events: ``ed_id, ent, level, basis, cut, score, score_low, score_high, prior_level, prior_score, delta,
    band, level_changed, unscored, season_median``.

    A score is the share of all recorded cuts of the level that are higher, ties half, in whole points; levels with fewer than
    ``min_n`` cuts have none. An event without a cut takes its projection (ed_id, pred, low, high), whose high bound gives the low
    score. Last season's score is against last season's level. The season's median change is of measured events only.
    """
    known = obs.where(F.col("cut") >= 3)
    cohorts = known.groupBy("level", "cut").agg(F.count(F.lit(1)).alias("f"))
    w = W.partitionBy("level").orderBy("cut")
    table = cohorts.select("level", "cut", "f", F.sum("f").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("f").over(W.partitionBy("level")).alias("n"))
    now = calendar.where(F.col("yr") == year).select("ed_id", "ent", "level")
    cut = obs.where(F.col("yr") == year).select("ed_id", "cut").join(projections, "ed_id", "full_outer")
    before = obs.where(F.col("yr") == year - 1).select("ent", F.col("level").alias("prior_level"), F.col("cut").alias("prior_cut"))
    rows = now.join(cut, "ed_id", "left").join(before, "ent", "left").withColumn("basis", F.when(F.col("cut").isNotNull(), "actual").when(F.col("pred").isNotNull(), "projected"))
    projected = F.col("basis") == "projected"
    probes = rows.select(
        "ed_id",
        F.explode(
            F.array(
                F.struct(F.lit("score").alias("as"), F.col("level").alias("level"), F.coalesce("cut", "pred").alias("probe")),
                F.struct(F.lit("score_low").alias("as"), F.col("level").alias("level"), F.when(projected, F.col("high")).alias("probe")),
                F.struct(F.lit("score_high").alias("as"), F.col("level").alias("level"), F.when(projected, F.col("low")).alias("probe")),
                F.struct(F.lit("prior_score").alias("as"), F.col("prior_level").alias("level"), F.col("prior_cut").alias("probe")),
            )
        ).alias("x"),
    ).select("ed_id", F.col("x.as").alias("as"), F.col("x.level").alias("level"), F.col("x.probe").alias("probe")).where("probe is not null")
    scored = probe_scores(probes, table, min_n)
    pick = lambda name: F.max(F.when(F.col("as") == name, F.col("score"))).alias(name)
    wide = scored.groupBy("ed_id").agg(pick("score"), pick("score_low"), pick("score_high"), pick("prior_score"))
    out = rows.join(wide, "ed_id", "left").withColumn("delta", F.col("score") - F.col("prior_score"))
    d = F.col("delta")
    band = F.when(d >= 30, "much-stronger").when(d >= 12, "stronger").when(d <= -30, "much-weaker").when(d <= -12, "weaker").when(d.isNotNull(), "similar")
    median = half_up(out.where("basis = 'actual'").agg(F.median("delta").alias("m")).scalar())
    return out.select(
        "ed_id", "ent", "level", "basis", F.coalesce("cut", "pred").alias("cut"), "score", "score_low", "score_high", "prior_level", "prior_score", "delta", band.alias("band"),
        (F.col("prior_level") != F.col("level")).alias("level_changed"), (F.col("basis").isNotNull() & F.col("score").isNull()).alias("unscored"), median.alias("season_median"),
    )


def probe_scores(probes: DataFrame, table: DataFrame, min_n: int = 8) -> DataFrame:
    """``probes`` (level, probe) with the share of their level's cuts that are higher, ties half, in whole points.

    ``table`` has level, cut, f (rows), upto (rows up to the cut) and n. One union and one window find the last cut at or below each probe.
    """
    own = table.select("level", F.col("cut").alias("at"), F.lit(0).alias("_side"), F.struct("cut", "f", "upto").alias("t"), F.lit(None).cast("string").alias("as"), F.lit(None).cast("long").alias("ed_id"), F.lit(None).cast("int").alias("probe"))
    ask = probes.select("level", F.col("probe").alias("at"), F.lit(1).alias("_side"), F.lit(None).cast(own.schema["t"].dataType).alias("t"), "as", F.col("ed_id").cast("long").alias("ed_id"), F.col("probe").cast("int").alias("probe"))
    w = W.partitionBy("level").orderBy("at", "_side").rowsBetween(W.unboundedPreceding, 0)
    found = own.unionByName(ask).withColumn("t", F.last("t", ignorenulls=True).over(w)).where("_side = 1")
    sizes = table.select("level", "n").distinct()
    got = found.join(sizes, "level").where(F.col("n") >= min_n)
    above = F.col("n") - F.coalesce(F.col("t.upto"), F.lit(0))
    same = F.when(F.col("t.cut") == F.col("probe"), F.col("t.f")).otherwise(0)
    return got.select("ed_id", "as", "level", "probe", half_up((above + same / 2) / F.col("n") * 100).cast("int").alias("score"))


def verdict(prior: Column, move: Column, spread: Column) -> Column:
    """Words for a year-over-year move; wide projections say nothing."""
    share = F.abs(move) / prior
    return F.when(prior.isNull() | (spread > 40), None).when(share < 0.1, "about the same").otherwise(F.concat(F.when(share >= 0.25, "much ").otherwise(""), F.when(move < 0, "stronger").otherwise("weaker")))


def reference_cuts(latest: DataFrame) -> DataFrame:
    """One row for each entity: main, qualifying and doubles cuts and the newest year among them."""
    pick = lambda e, d, c: F.max(F.when((F.col("ev") == e) & (F.col("dr") == d), F.col(c)))
    return latest.groupBy("ent").agg(pick("singles", "main", "direct_rank").alias("main_cut"), pick("singles", "main", "alt_rank").alias("main_alt"), pick("singles", "qualifying", "direct_rank").alias("qual_cut"), pick("doubles", "main", "cut").alias("doubles_cut"), F.max("yr").alias("from_year"))


def entry_status(rank: Column, main: Column, alt: Column, qual: Column, main_open: Column, qual_open: Column) -> Column:
    best = F.greatest(main, alt)
    return (
        F.when(main_open, "main").when(best.isNotNull() & (rank <= best), "main").when(qual_open, "qualifying")
        .when(qual.isNotNull() & (rank <= qual), "qualifying").when(best.isNull() & qual.isNull(), "unknown").otherwise("out")
    )


def week_calendar(events: DataFrame) -> DataFrame:
    """Events by week; a longer event has continuation rows, and each week the first date of its own events."""
    rows = joins.span_scope(events, "wk", "span", "at").withColumn("primary", F.col("at") == F.col("wk"))
    return rows.withColumn("week_start", F.min(F.when(F.col("primary"), F.col("start_date"))).over(W.partitionBy("yr", "at")))


def resolve_stop(stops: DataFrame, history: DataFrame, prior: DataFrame) -> DataFrame:
    """Own cut, else the entity's newest earlier one, else the reference of a similar event."""
    h = history.select(F.col("ed_id"), F.col("cut").alias("_h"))
    p = prior.select("ed_id", F.col("ref_cut").alias("_p"))
    src = F.when(F.col("cut").isNotNull(), "own").when(F.col("_h").isNotNull(), "history").when(F.col("_p").isNotNull(), "reference").otherwise("none")
    return stops.join(h, "ed_id", "left").join(p, "ed_id", "left").select("ed_id", F.coalesce("cut", "_h", "_p").alias("cut"), src.alias("src"))


#: Category, kind, days before the event's Monday, label, note on the time.
DEADLINES = [
    ("tour", "main", 28, "Singles main draw", "12:00 noon ET"), ("tour", "qualifying", 21, "Singles qualifying", "12:00 noon ET"), ("tour", "doubles", 14, "Doubles (advance entry)", "12:00 noon ET"),
    ("challenger", "main", 21, "Singles main draw", "12:00 noon ET"), ("challenger", "qualifying", 19, "Singles qualifying", "12:00 noon ET (Wed)"), ("challenger", "doubles", 7, "Doubles (advance entry)", "12:00 noon ET"),
    ("itf", "entry", 18, "Entry deadline", "14:00 GMT (Thu)"),
    ("slam", "main", 42, "Singles main draw", "time per event"), ("slam", "qualifying", 28, "Singles qualifying", "time per event"), ("slam", "doubles", 14, "Doubles (advance entry)", "approx.; set by each event"),
]
#: Order of the categories in a reminder.
BANDS = [("slam", 1), ("tour", 2), ("challenger", 3), ("itf", 4)]


def deadlines(editions: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``ed_id, level, category, kind, label, monday, due, due_at, time_note, overridden, qualifying_due``.

    The rules of the level's category, counted from the event's Monday; overrides (ed_id, kind, due) win. ``due_at`` is noon in
    New York, or 14:00 UTC for ITF. A slam's main draw also carries the date of its qualifying deadline; the separate slam
    qualifying event has no deadlines of its own.
    """
    rules = editions.sparkSession.createDataFrame(DEADLINES, "category string, kind string, days int, label string, time_note string")
    e = editions.where(~levels.is_slam_qualifying(F.col("level"))).withColumn("category", levels.category(F.col("level")))
    e = e.withColumn("monday", dates.monday_of(F.col("start_date")))
    due = e.join(F.broadcast(rules), "category").withColumn("due", F.expr("date_sub(monday, days)"))  # ten rules
    if overrides is not None:
        due = due.join(overrides.withColumnRenamed("due", "_due"), ["ed_id", "kind"], "left")
    else:
        due = due.withColumn("_due", F.lit(None).cast("date"))
    slam_q = next(days for c, k, days, *_ in DEADLINES if (c, k) == ("slam", "qualifying"))
    last = F.coalesce("_due", "due")
    return due.select(
        "ed_id", "level", "category", "kind", "label", "monday", last.alias("due"), dates.deadline_moment(last, F.col("category") != "itf").alias("due_at"), "time_note", F.col("_due").isNotNull().alias("overridden"),
        F.when((F.col("category") == "slam") & (F.col("kind") == "main"), F.date_sub("monday", slam_q)).alias("qualifying_due"),
    )


def due_reminders(due: DataFrame, as_of: Column, windows: list[int], categories: list[str] | None = None, doubles: bool = False) -> DataFrame:
    """``key, category, kind, due, n, hours_left, windows, claims, prestige`` of the deadlines ahead within the longest window.

    ``windows`` are those that have opened. All ITF events of a week are one row. ``claims`` has a key for each open window; that
    of 24 hours is the plain key. Rows are in the order of ``prestige`` (category, then the larger number in the level), due.
    """
    left = (F.unix_timestamp("due_at") - F.unix_timestamp(as_of)) / 3600
    near = due.withColumn("h", left).where((F.col("h") > 0) & (F.col("h") <= max(windows)))
    if categories is not None:
        near = near.where(F.col("category").isin(categories))
    if not doubles:
        near = near.where("kind <> 'doubles'")
    itf = F.col("category") == "itf"
    key = F.when(itf, F.concat(F.lit("itf-week-"), F.col("monday").cast("string"))).otherwise(F.col("ed_id").cast("string"))
    band = F.coalesce(*(F.when(F.col("category") == c, F.lit(b)) for c, b in BANDS))
    number = F.when(itf, F.lit(0)).otherwise(F.coalesce(F.nullif(F.regexp_extract("level", "([0-9]+)", 1), F.lit("")).cast("int"), F.lit(0)))
    rows = near.groupBy(key.alias("id"), "category", "kind").agg(F.min("due").alias("due"), F.min("h").alias("h"), F.count(F.lit(1)).alias("n"), F.min(band * 100_000 - number).alias("prestige"))
    opened = F.filter(F.array(*(F.lit(w) for w in sorted(windows, reverse=True))), lambda w: F.col("h") <= w)
    plain = F.concat_ws(":", "id", "kind")
    claims = F.transform(opened, lambda w: F.when(w == 24, plain).otherwise(F.concat(plain, F.lit(":"), w.cast("string"), F.lit("h"))))
    out = rows.select(plain.alias("key"), "category", "kind", "due", "n", half_up(F.col("h"), 1).alias("hours_left"), F.array_join(F.transform(opened, lambda w: w.cast("string")), ",").alias("windows"), F.array_join(claims, ",").alias("claims"), "prestige")
    return out.orderBy("prestige", "due", "key")


def missing_report(expected: DataFrame, present: DataFrame, codes: DataFrame) -> DataFrame:
    """For each edition the number of expected and present draws, the missing ones, the code, how sure it is and what to do next.

    ``codes`` has ed_id, registered (of the registry) and found (in a source text).
    """
    have = present.select("ed_id", "ev", "dr").distinct().withColumn("_p", F.lit(True))
    both = expected.join(have, ["ed_id", "ev", "dr"], "left")
    name = F.when(F.col("_p").isNull(), F.concat_ws("-", "ev", "dr"))
    rows = both.groupBy("ed_id").agg(F.count(F.lit(1)).alias("expected"), F.count("_p").alias("present"), F.array_join(F.array_sort(F.collect_list(name)), ",").alias("missing"))
    code = F.coalesce("registered", "found")
    sure = F.when(F.col("registered").isNotNull(), "high").when(F.col("found").isNotNull(), "medium").otherwise("low")
    action = F.when(F.col("missing") == "", "complete").when(code.isNotNull(), "fetch").otherwise("discover code")
    return rows.join(codes, "ed_id", "left").select("ed_id", "expected", "present", "missing", code.alias("code"), sure.alias("confidence"), action.alias("next_action"))


def coverage_totals(expected: DataFrame, present: DataFrame, editions: DataFrame) -> DataFrame:
    """``level, ev, dr, expected, existing, missing, nulls`` over all, by level and by draw (a column outside its slice is null).
    ``present`` has ed_id, ev, dr, value; a row without a value exists but is null, and is missing."""
    have = present.groupBy("ed_id", "ev", "dr").agg(F.count("value").alias("_v"), F.lit(True).alias("_e"))
    both = expected.join(editions.select("ed_id", "level"), "ed_id").join(have, ["ed_id", "ev", "dr"], "left")
    some = F.coalesce(F.col("_v") > 0, F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    metrics = [F.count(F.lit(1)).alias("expected"), count(F.col("_e")).alias("existing"), count(~some).alias("missing"), count(F.col("_e") & ~some).alias("nulls")]
    return both.groupingSets([[], [F.col("level")], [F.col("ev"), F.col("dr")]], "level", "ev", "dr").agg(*metrics)


def phase_and_label(df: DataFrame, as_of: Column) -> DataFrame:
    """``phase`` (past, current, upcoming; undated rows are upcoming), a relative ``label``, and ``phase_no`` and ``place``, by which rows are shown:
    current and upcoming ones from the first start on (undated last), past ones from the last.

    An event without an end lasts a week. Weeks run from Monday, so "next week" is the next one of the calendar.
    """
    last = F.coalesce("end_date", F.date_add("start_date", 6))
    start = F.col("start_date")
    phase = F.when(start.isNull() | last.isNull(), "upcoming").when(last < as_of, "past").when(start <= as_of, "current").otherwise("upcoming")
    week = lambda d: F.floor((F.unix_date(d) + 3) / 7)
    rounded = lambda x: F.floor(x + 0.5).cast("long")
    counted = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
    days, weeks, ago = F.datediff(start, as_of), week(start) - week(as_of), F.datediff(as_of, last)
    soon = F.when(days == 1, "Starts tomorrow").otherwise(F.concat(F.lit("Starts in "), days.cast("string"), F.lit(" days")))
    ahead = F.when(weeks == 0, soon).when(weeks == 1, "Next week").when(weeks < 9, F.concat(F.lit("In "), weeks.cast("string"), F.lit(" weeks"))).otherwise(F.concat(F.lit("In "), counted(rounded(days / 30), "month")))
    years = F.greatest(F.lit(1), rounded(ago / 365))
    back = (
        F.when(ago < 8, "Last week").when(ago < 60, F.concat(rounded(ago / 7).cast("string"), F.lit(" weeks ago"))).when(ago < 330, F.concat(counted(rounded(ago / 30), "month"), F.lit(" ago")))
        .when(years == 1, "Last year").otherwise(F.concat(years.cast("string"), F.lit(" years ago")))
    )
    tagged = df.withColumn("phase", phase)
    is_ = lambda name: F.col("phase") == name
    label = F.when(start.isNull(), "Dates TBD").when(is_("current"), "This week").when(is_("upcoming"), ahead).otherwise(back)
    number = F.when(is_("current"), 0).when(is_("upcoming"), 1).otherwise(2)
    day = F.unix_date(start)
    place = F.when(is_("past"), -day).otherwise(F.coalesce(day, F.lit(1 << 30)))
    return tagged.withColumn("label", label).withColumn("phase_no", number).withColumn("place", place)


def fill_from_siblings(df: DataFrame, key: str, id: str, column: str, overrides: DataFrame) -> DataFrame:
    """An override wins, then the row's own value, then that of the sibling with the smallest id under the same key."""
    sib = df.where(F.col(column).isNotNull()).groupBy(key).agg(F.min_by(column, id).alias("_s"))
    o = overrides.select(id, F.col(column).alias("_o"))
    out = df.join(sib, key, "left").join(o, id, "left")
    src = F.when(F.col("_o").isNotNull(), "override").when(F.col(column).isNotNull(), "own").when(F.col("_s").isNotNull(), "sibling").otherwise("none")
    return out.select(id, F.coalesce("_o", column, "_s").alias(column), src.alias("src"))


def schedule(exact: DataFrame, generic: DataFrame, year: int) -> DataFrame:
    """The season's editions: ``ed_id, level, start_date, wk, overlaid``.

    ``exact`` and ``generic`` have ed_id, yr, start_date, level, surface, slug, name, city, updated. A generic row takes week, date and level of its
    best exact match (``joins.ladder_match``); then one row is kept for a name (without brackets and numbers; ITF rows by their own
    slug) and calendar week, the one written last. The week is that of the date.
    """
    best = joins.ladder_match(generic, exact, by_score=False).select("gid", F.col("x_start_date").alias("_d"), F.col("x_level").alias("_l"))
    over = generic.join(best, generic["ed_id"] == best["gid"], "left").drop("gid")
    held = exact.where("status = 'held'").drop("status") if "status" in exact.columns else exact
    every = over.unionByName(held.withColumn("_d", F.lit(None).cast("date")).withColumn("_l", F.lit(None).cast("string")))
    live = every.where((F.col("yr") == year) & dates.in_season(F.col("start_date"), F.lit(year), F.col("level")))
    itf = F.col("level").startswith("ITF")
    tagged = live.withColumn("_key", text.schedule_name_key(F.col("name"))).withColumn("_week", dates.monday_of(F.col("start_date"))).withColumn("_own", F.when(itf, F.col("slug")).otherwise(""))
    kept = joins.pick(tagged, ["_key", "_week", "_own"], [F.col("updated").desc_nulls_last(), F.col("ed_id")])
    shown = F.coalesce("_d", "start_date")
    return kept.select("ed_id", F.coalesce("_l", "level").alias("level"), shown.alias("start_date"), dates.season_week(shown, F.lit(year)).alias("wk"), F.col("_d").isNotNull().alias("overlaid"))


def nearest_week(events: DataFrame, year: int, week: int) -> int:
    """``week`` itself if the season has events in it, else the nearest week that has (the earlier of two)."""
    weeks = events.where(F.col("yr") == year).select("wk").distinct()
    first = weeks.orderBy(F.abs(F.col("wk") - week), "wk").first()  # one row
    return first["wk"] if first else week


def week_view(events: DataFrame, last_cut: DataFrame, year: int, week: int, km: float = 1500) -> DataFrame:
    """The events of a season's week (or the nearest with events): ``ed_id, week, region, cluster, places, rank, competing, reasons, last_cut``.

    Clusters are of events within ``km``; inside one, more rounded places come first. Reasons are the three largest contributions to
    the depth. The region is of the cluster's mean coordinates.
    """
    from tideline.operators.chains import cluster_within
    from tideline.operators.windows import top_contributors

    at = nearest_week(events, year, week)
    scope = events.where((F.col("yr") == year) & (F.col("wk") <= at) & (F.col("wk") > at - len(levels.DECAY)))
    mine = scope.where(F.col("wk") == at)
    d = depth(scope).withColumn("places", half_up(F.col("depth")).cast("int"))
    parts = contributions(scope)
    top = top_contributors(parts, "ed_id", "contribution", "other")
    why = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind", "other"))), lambda r: F.concat_ws(":", r["kind"], r["other"].cast("string"))), ", ")
    reasons = top.groupBy("ed_id").agg(F.max("of").alias("competing"), why.alias("reasons"))
    placed = mine.join(cluster_within(mine, ["yr"], "wk", km), "ed_id")
    centre = placed.groupBy("cluster").agg(region_label(F.avg("lat"), F.avg("lon")).alias("region"))
    rank = F.rank().over(W.partitionBy("cluster").orderBy(F.col("places").desc()))
    got = placed.join(d.select("ed_id", "places"), "ed_id").join(centre, "cluster").join(reasons, "ed_id", "left").join(last_cut, "ed_id", "left")
    return got.select("ed_id", F.lit(at).alias("week"), "region", "cluster", "places", rank.alias("rank"), F.coalesce("competing", F.lit(0)).cast("long").alias("competing"), F.coalesce("reasons", F.lit("")).alias("reasons"), "last_cut")


def coverage(scored: DataFrame) -> DataFrame:
    """``yr, n, with_cut``."""
    return scored.groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.count("cut").alias("with_cut"))


def depth_validation(scored: DataFrame) -> dict[str, DataFrame]:
    """Validation of depth against cuts: coverage, order inside clusters, binned curve, changes, restructured weeks and held-out slopes.

    ``scored`` has ed_id, ent, yr, wk, grp, depth, cut and, for the order, cluster. It is read several times and should be a written table.
    """
    from tideline.operators import aggregates as ag

    both = scored.where("cut is not null")
    earlier = both.select("ent", (F.col("yr") + 1).alias("yr"), F.col("depth").alias("depth0"), F.col("cut").alias("cut0"))
    moved = both.join(earlier, ["ent", "yr"])
    moved = moved.withColumn("d_depth", F.col("depth") - F.col("depth0")).withColumn("d_cut", (F.col("cut") - F.col("cut0")).cast("double"))
    moved = moved.withColumn("restructured", F.abs("d_depth") >= 3)
    fits = ag.leave_one_out_fits(moved, "yr", "d_depth", "d_cut")
    error = F.abs(F.col("d_cut") - F.col("slope") * F.col("d_depth"))
    held = moved.join(fits, "yr").groupBy("yr", "train_n", "slope", "restructured").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mae"), F.avg(F.abs("d_cut")).alias("base_mae"))
    out = {
        "coverage": coverage(scored),
        "rank": ag.correlation(both, ["yr"], "depth", "cut", "spearman"),
        "curve": ag.binned(both, "depth", "cut", 10, 20, ["grp"]),
        "changes": moved.groupBy("yr").agg(F.count(F.when(F.abs("d_depth") >= 3, 1)).alias("moved3"), F.count(F.when(F.abs("d_depth") >= 7, 1)).alias("moved7")),
        "restructured": moved.groupBy("restructured").agg(F.count(F.lit(1)).alias("n"), F.avg("d_depth").alias("mean_depth"), F.avg("d_cut").alias("mean_cut")),
        "held_out": held.where("train_n >= 30"),
    }
    return out | ({"order": ag.concordance(both, ["cluster"], "ed_id", "depth", "cut")} if "cluster" in scored.columns else {})


def drain_validation(drained: DataFrame, obs: DataFrame) -> DataFrame:
    """Held-out slope of the log cut ratio on the change of drained places, by season: the error over all, by exposure, and of
    the events whose drain moved by 24 places or more; Spearman of the two for the same slices."""
    from tideline.operators import aggregates as ag

    x = obs.join(drained.select("ed_id", "places", "exposure"), "ed_id")
    m = joins.prior_period(joins.prior_period(x, ["ent"], "yr", "places", "p0"), ["ent"], "yr", "cut", "c0").where("c0 is not null and p0 is not null")
    m = m.withColumn("dx", (F.col("places") - F.col("p0")).cast("double")).withColumn("dy", F.log(F.col("cut") / F.col("c0")))
    fits = ag.leave_one_out_fits(m, "yr", "dx", "dy").where("train_n >= 30")
    parts = F.array(F.lit("all"), F.concat(F.lit("exposure:"), "exposure"), F.when(F.abs("dx") >= 24, F.lit("moved")))
    sliced = m.withColumn("slice", F.explode(F.array_compact(parts)))
    errors = sliced.join(fits, "yr").groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("dy") - F.col("slope") * F.col("dx"))).alias("mae"), F.avg(F.abs("dy")).alias("base_mae"))
    return errors.join(ag.correlation(sliced, ["slice"], "dx", "dy", "spearman").select("slice", "r"), "slice", "left")


def compute_cut(entrants: DataFrame, ranks: DataFrame, levels_of: DataFrame) -> DataFrame:
    """``draw, cut, player, direct, unmatched, ambiguous, plausible, confidence`` from a draw's entrants and a ranking.

    Entrants have draw, name_key, route, on_date; of a name's several rows the strongest route marker counts, and only direct ones
    set a cut. A rank is that of the last ranking (name_key, player, rank, rank_date) at or before the draw's date; a name that two
    players share is ambiguous. ``levels_of`` has draw, level, ev, dr; a cut outside the level's plausible range is not sure.
    """
    from tideline.functions import cuts

    strongest = entrants.groupBy("draw", "name_key", "on_date").agg(F.max("route").alias("route")).where("route = ''")
    names = ranks.groupBy("name_key").agg(F.count_distinct("player").alias("players"))
    one = ranks.join(names.where("players = 1").select("name_key"), "name_key", "left_semi").groupBy("name_key", "rank_date").agg(F.min("rank").alias("rank"))
    direct = joins.as_of(strongest, one, ["name_key"], "on_date", "rank_date", ["rank"]).join(names, "name_key", "left")
    ambiguous = F.col("players") > 1
    got = direct.groupBy("draw").agg(
        F.max("asof_rank").alias("cut"), F.max_by("name_key", F.struct("asof_rank", "name_key")).alias("player"), F.count(F.lit(1)).alias("direct"),
        F.count(F.when(F.col("asof_rank").isNull() & ~F.coalesce(ambiguous, F.lit(False)), 1)).alias("unmatched"), F.count(F.when(ambiguous, 1)).alias("ambiguous"),
    )
    least = cuts.min_plausible(F.col("level"), F.col("ev"), F.col("dr"))
    out = got.join(levels_of, "draw", "left").withColumn("plausible", F.coalesce(F.col("cut").between(least, F.lit(2500)), F.lit(False)))
    sure = F.when(~F.col("plausible"), "low").when(F.col("unmatched") + F.col("ambiguous") == 0, "high").otherwise("medium")
    return out.select("draw", "cut", F.when(F.col("cut").isNotNull(), F.col("player")).alias("player"), "direct", "unmatched", "ambiguous", "plausible", sure.alias("confidence"))


def code_audit(missing: DataFrame, own: DataFrame, by_city: DataFrame) -> DataFrame:
    """For editions without a cut: own code, recoverable from the city's newest code, or to be discovered."""
    a, b = own.select("ent", F.col("code").alias("_a")), by_city.select("city", F.col("code").alias("_b"))
    kind = F.when(F.col("_a").isNotNull(), "own").when(F.col("_b").isNotNull(), "city").otherwise("discover")
    return missing.join(a, "ent", "left").join(b, "city", "left").select("ed_id", kind.alias("kind"), F.coalesce("_a", "_b").alias("code"))


def match_evidence(pairs: DataFrame) -> DataFrame:
    """Points for a shared token, city, month and week: high from 4, medium 3, low 2, else none."""
    points = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("token", "same_city", "same_month", "same_week")), F.lit(0))
    return pairs.withColumn("points", points).withColumn("evidence", F.when(points >= 4, "high").when(points == 3, "medium").when(points == 2, "low").otherwise("none"))


def health(freshness: DataFrame, coverage: DataFrame, gaps: DataFrame, editions: DataFrame, as_of: Column, season: int) -> DataFrame:
    """``check, ok`` of all checks: source freshness, coverage of the events of 14 to 70 days ago (70 %), weeks ahead without events, the
    calendar of the next season by month (as many events as half of this season's), and cancellations of the last 30 days."""
    a = freshness.select(F.concat(F.lit("fresh:"), F.col("source")).alias("check"), (~F.col("stale")).alias("ok"))
    age = F.datediff(as_of, "start_date")
    recent = coverage.where(age.between(14, 70)).groupBy("category").agg((F.count("cut") / F.count(F.lit(1))).alias("share"))
    b = recent.select(F.concat(F.lit("coverage:"), F.col("category")).alias("check"), (F.col("share") >= 0.7).alias("ok"))
    c = gaps.select(F.concat(F.lit("week:"), F.col("week").cast("string")).alias("check"), (F.col("severity") != "critical").alias("ok"))
    month = F.month("start_date")
    of = lambda y, name: F.count(F.when(F.col("yr") == y, 1)).alias(name)
    months = editions.where(F.col("yr").isin(season, season + 1)).groupBy(month.alias("m")).agg(of(season, "now"), of(season + 1, "next"))
    d = months.select(F.concat(F.lit("calendar:"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("check"), (F.col("next") * 2 >= F.col("now")).alias("ok"))
    gone = editions.where((F.col("status") == "not_held") & F.datediff(as_of, "start_date").between(0, 30))
    e = gone.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("cancelled").alias("check"), (F.col("n") == 0).alias("ok"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)


def sheet_index(editions: DataFrame, codes: DataFrame, as_of: Column, lead_days: int) -> DataFrame:
    """``ent, code, newest, level, sheets``: for each entity with a code of any season, the seasons of its editions that start no later
    than the lead window, newest first, and the newest one's level."""
    shown = editions.where(F.datediff("start_date", as_of) <= lead_days)
    years = F.array_join(F.transform(F.sort_array(F.collect_set("yr"), asc=False), lambda y: y.cast("string")), ",")
    rows = shown.groupBy("ent").agg(F.max("yr").alias("newest"), F.max_by("level", F.struct("yr", "ed_id")).alias("level"), years.alias("sheets"))
    return rows.join(codes, "ent").select("ent", "code", "newest", "level", "sheets")


def missing_codes(editions: DataFrame, codes: DataFrame, as_of: Column) -> DataFrame:
    """Editions of the next six weeks without a code: critical within two weeks."""
    days = F.datediff("start_date", as_of)
    near = editions.where(days.between(0, 42)).join(codes.select("ent"), "ent", "left_anti")
    return near.select("ed_id", F.when(days <= 14, "critical").otherwise("warn").alias("severity"))
