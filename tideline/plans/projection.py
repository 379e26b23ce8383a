"""Projection of thresholds: tier change, season and regional drift, cohort base, supply, prediction, backtest.

Observations have ed_id, ent, yr, wk, level, lat, lon, cut, all of one event and draw. Every factor is a table keyed by the
target, made by equi-joins on (group, season[, week[, place]]); no step loops over targets. Targets at one place in one week
share their factors, so that pairs are of distinct places and not of targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import levels
from tideline.functions.geo import clamp, winsorize
from tideline.operators import aggregates, joins, merge, nearby, ranks, windows
from tideline.storage import materialise

#: Fixed values by draw: weight of the last season, shrinkage to the cohort, half-width of the band by tier.
BLEND = {"ms": 0.7, "qs": 0.65, "md": 0.8}
SHRINK = {"ms": 0.75, "qs": 0.6, "md": 0.6}
BAND = {"ms": {"gs": 0.08, "tour": 0.23, "challenger": 0.25}, "qs": {"gs": 0.15, "tour": 0.5, "challenger": 0.43}, "md": {"gs": 0.15, "tour": 0.35, "challenger": 0.47}}


def with_group(obs: DataFrame) -> DataFrame:
    return obs.withColumn("grp", levels.tier_group(F.col("level"))).where("grp is not null")


def ratios(obs: DataFrame) -> DataFrame:
    """Observations with exactly last season's cut and the ratio to it."""
    return joins.prior_period(obs.where("cut is not null"), ["ent"], "yr", "cut", "prev").where("prev is not null").withColumn("ratio", F.col("cut") / F.col("prev"))


def level_medians(obs: DataFrame) -> DataFrame:
    """Median cut of each level over all seasons before each season; thin ones (n < 8) are left out.

    Cuts are counted by value first, so that what is copied to later seasons are (level, season, value) and not observations.
    """
    values = obs.where("cut is not null").groupBy("level", "yr", "cut").agg(F.count(F.lit(1)).alias("f"))
    last = obs.agg(F.max("yr").alias("y")).scalar()
    later = values.where(F.col("yr") < last).withColumn("y", F.explode(F.sequence(F.col("yr") + 1, last))).drop("yr")
    seen = later.join(obs.select(F.col("yr").alias("y")).distinct(), "y")
    return seen.groupBy("level", "y").agg(F.percentile("cut", F.lit(0.5), F.col("f")).alias("med"), F.sum("f").alias("n")).where("n >= 8").select("level", F.col("y").alias("yr"), "med")


def tier_change_factor(targets: DataFrame, obs: DataFrame) -> DataFrame:
    """``targets`` (last_level, level, yr) with the clamped ratio of the two levels' medians; 1 if same or thin."""
    m = materialise(level_medians(obs), "level-medians")  # a few rows, read twice
    a = m.select(F.col("level").alias("last_level"), "yr", F.col("med").alias("_from"))
    b = m.select("level", "yr", F.col("med").alias("_to"))
    factor = F.when(F.col("last_level").isNull() | (F.col("last_level") == F.col("level")) | F.col("_from").isNull() | F.col("_to").isNull(), 1.0).otherwise(clamp(F.col("_to") / F.col("_from"), 0.55, 1.8))
    return targets.join(a, ["last_level", "yr"], "left").join(b, ["level", "yr"], "left").withColumn("tier_factor", factor).drop("_from", "_to")


def season_drift(obs: DataFrame, horizons: list[int] | None = None) -> DataFrame:
    """For each (horizon, grp, yr, wk): the clamped median ratio of the season's weeks strictly before wk - horizon; 1 below 8
    rows. Distinct weeks are asked, and a ratio is stored by ranges of weeks, not copied to the later ones. Without ``horizons`` there
    is one, 0, and no such column."""
    out = _season(obs, ratios(obs), horizons or [0])
    return out if horizons else out.drop("horizon")


def _season(obs: DataFrame, rated: DataFrame, horizons: list[int]) -> DataFrame:
    keys = obs.select("grp", "yr", "wk").distinct().withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    before = keys.withColumn("at", F.col("wk") - F.col("horizon"))
    med = ranks.prefix_medians(rated.select("grp", "yr", F.col("wk").alias("at"), "ratio"), before, ["grp", "yr"], "at", "ratio")
    drift = F.when(F.col("n") >= 8, clamp(F.col("median"), 0.6, 1.6)).otherwise(1.0)
    return before.join(med, ["grp", "yr", "at"], "left").select("horizon", "grp", "yr", "wk", drift.alias("drift"))


#: What tells targets apart in space and time: factors are computed once for each and joined back.
SPOT = ["grp", "yr", "wk", "lat", "lon"]
#: Fixed value: how far regional ratios and cohorts reach.
NEAR_KM = 3000


def _with_spots(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """``rows`` with the columns of their spot (null coordinates are alike); null without one."""
    s = spots.select(*(F.col(c).alias(f"_s_{c}") if c in SPOT else F.col(c) for c in spots.columns))
    return rows.join(s, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) if c in ("lat", "lon") else F.col(c) == F.col(f"_s_{c}") for c in SPOT], "left").drop(*(f"_s_{c}" for c in SPOT))


def _regional(spots: DataFrame, rated: DataFrame, horizons: list[int], km: float) -> DataFrame:
    """``SPOT, near``: the clamped median by horizon, for the spots with three ratios (SPOT, ratio) or more around."""
    windows = {h: [-k - h for k in (1, 2, 3)] for h in horizons}
    med = nearby.near_medians(spots, rated.select(*SPOT, F.col("ratio").alias("x"), F.lit(1).alias("f")), ["grp", "yr"], "wk", windows, km)
    return med.where("n >= 3").select(*SPOT, F.col("window").alias("k"), clamp(F.col("median"), 0.6, 1.6).alias("near"))


def _by_spot(near: DataFrame) -> DataFrame:
    """``SPOT, near``: a map from k."""
    return near.groupBy(*SPOT).agg(F.map_from_entries(F.collect_list(F.struct("k", "near"))).alias("near"))


def regional_drift(obs: DataFrame, horizons: list[int] | None = None, km: float = NEAR_KM) -> DataFrame:
    """``horizon, ed_id, regional``: the same over events within ``km`` in the three weeks before; 1 below 3 rows."""
    every = horizons or [0]
    o = materialise(obs.select("ed_id", "ent", *SPOT, "cut"), "regional-observations")  # read for spots, ratios and targets
    near = _by_spot(_regional(o.select(*SPOT).distinct(), ratios(o), every, km))
    out = _with_spots(o, near).withColumn("horizon", F.explode(F.array(*map(F.lit, every)))).select("horizon", "ed_id", F.coalesce(F.try_element_at("near", F.col("horizon")), F.lit(1.0)).alias("regional"))
    return out if horizons else out.drop("horizon")


def _cohorts(obs: DataFrame, km: float) -> tuple[DataFrame, DataFrame]:
    """``grp, yr, wk, every``: last season's median within two weeks, of three cuts or more; and ``SPOT, k (-1), near``: that of the near ones."""
    last = obs.where("cut is not null").select("grp", (F.col("yr") + 1).alias("yr"), "wk", "lat", "lon", "cut")
    weeks = last.groupBy("grp", "yr", "wk", "cut").agg(F.count(F.lit(1)).alias("f")).withColumn("wk", F.explode(F.array(*(F.col("wk") + k for k in range(-2, 3)))))
    every = weeks.groupBy("grp", "yr", "wk").agg(F.percentile("cut", F.lit(0.5), F.col("f")).alias("every"), F.sum("f").alias("n")).where("n >= 3")
    near = nearby.near_medians(obs.select(*SPOT).distinct(), last.select(*SPOT, F.col("cut").alias("x"), F.lit(1).alias("f")), ["grp", "yr"], "wk", {-1: [-2, -1, 0, 1, 2]}, km)
    return every.drop("n"), near.where("n >= 3").select(*SPOT, F.col("window").alias("k"), F.col("median").alias("near"))


def cohort_base(obs: DataFrame, km: float = NEAR_KM) -> DataFrame:
    """``ed_id, cohort``: last season's median of the same group within two weeks, of the near ones if there are three.

    The median of all is one for each (group, season, week); near ones are looked for by place. Cuts are counted by value.
    """
    o = materialise(obs.select("ed_id", *SPOT, "cut"), "cohort-observations")
    every, near = _cohorts(o, km)
    base = _with_spots(o.join(materialise(every, "cohort-weeks"), ["grp", "yr", "wk"]), near.drop("k"))
    return base.select("ed_id", F.coalesce("near", "every").alias("cohort"))


def supply_signals(events: DataFrame, km: float = 3000) -> DataFrame:
    """``ed_id, supply, runup``: regional weight of the calendar against last season's, each plus 1: of the week and its neighbours, and of the
    neighbourhoods of the weeks two and three before. Null for events without a place.

    Of the weeks before, the second and third lie in both neighbourhoods and count twice.
    """
    spot = ["yr", "wk", "lat", "lon"]
    e = events.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy(*spot).agg(F.sum(levels.supply_weight(F.col("level"))).alias("w"))
    times = F.when((F.col("wk") - F.col("r_wk")).isin(2, 3), 2).otherwise(1)
    near = lambda other: joins.near_in_time_space(e.drop("w"), other, ["yr"], "wk", [-4, -3, -2, -1, 0, 1], km)
    mass = lambda low, high, n: F.coalesce(F.sum(F.when((F.col("r_wk") - F.col("wk")).between(low, high), F.col("r_w") * n)), F.lit(0.0))
    sums = lambda other, name: near(other).groupBy(*spot).agg(mass(-1, 1, 1).alias(f"same_{name}"), mass(-4, -1, times).alias(f"run_{name}"))
    both = sums(e, "now").join(sums(e.withColumn("yr", F.col("yr") + 1), "was"), spot, "left")
    ratio = lambda kind: (F.col(f"{kind}_now") + 1) / (F.coalesce(f"{kind}_was", F.lit(0.0)) + 1)
    return events.select("ed_id", *spot).join(both, spot, "left").select("ed_id", ratio("same").alias("supply"), ratio("run").alias("runup"))


def supply(events: DataFrame, km: float = 3000) -> DataFrame:
    """``ed_id, supply``: the signal of the same week."""
    return supply_signals(events, km).select("ed_id", "supply")


def _band(grp: Column, draw: str) -> Column:
    out = F.lit(None).cast("double")
    for g, w in BAND[draw].items():
        out = F.when(grp == g, w).otherwise(out)
    return out


def predict(obs: DataFrame, draw: str = "ms", horizon: int = 0, supply_power: float = 0.0, events: DataFrame | None = None) -> DataFrame:
    """``ed_id, grp, yr, actual, last, pred, low, high, method`` for every observation, from what was visible before it."""
    return predict_horizons(obs, draw, [horizon], supply_power, events).drop("horizon")


def predict_horizons(obs: DataFrame, draw: str, horizons: list[int], supply_power: float = 0.0, events: DataFrame | None = None, factors: bool = False) -> DataFrame:
    """``predict`` for several horizons in one pass, with the column ``horizon``; only the drifts depend on it. With ``factors`` there are
    the columns drift and regional too.

    An entity has one observation a season. Its earlier ones come from one window; what depends on the week or the place is written as
    tables by week and by spot, so that the last plan is a scan with four joins.
    """
    o = materialise(with_group(obs), "observations")
    w = W.partitionBy("ent").orderBy("yr")
    ago = lambda column, years, name: F.last(column).over(w.rangeBetween(-years, -years)).alias(name)
    past = windows.prior_history(o, ["ent"], "yr", "cut").select("*", ago("cut", 1, "last"), ago("cut", 2, "before"), ago("level", 1, "last_level"))
    t = materialise(past, "histories")
    rated = t.where("cut is not null and last is not null").select(*SPOT, (F.col("cut") / F.col("last")).alias("ratio"))
    every, close = _cohorts(t, NEAR_KM)
    near = materialise(_by_spot(close.unionByName(_regional(t.select(*SPOT).distinct(), rated, horizons, NEAR_KM))), "spot-factors")
    drifts = _season(t, rated, horizons).groupBy("grp", "yr", "wk").agg(F.map_from_entries(F.collect_list(F.struct("horizon", "drift"))).alias("drifts"))
    weekly = materialise(drifts.join(every, ["grp", "yr", "wk"], "left"), "week-factors")
    t = _with_spots(tier_change_factor(t, t).join(weekly, ["grp", "yr", "wk"]), near).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    t = t.withColumn("cohort", F.coalesce(F.try_element_at("near", F.lit(-1)), "every"))
    t = t.withColumn("drift", F.try_element_at("drifts", F.col("horizon"))).withColumn("regional", F.coalesce(F.try_element_at("near", F.col("horizon")), F.lit(1.0)))
    if supply_power:
        t = t.join(supply(events), "ed_id", "left")
    last = F.when(F.col("prior_n") >= 2, winsorize(F.col("last").cast("double"), F.col("prior_median"), 1.75)).otherwise(F.col("last").cast("double"))
    own = F.when(F.col("before").isNotNull(), BLEND[draw] * last + (1 - BLEND[draw]) * F.col("before")).otherwise(last)
    own = own * F.col("tier_factor") * F.pow("drift", F.lit(0.25)) * F.pow("regional", F.lit(0.2))
    base = F.when(own.isNull(), F.col("cohort")).when(F.col("cohort").isNull(), own).otherwise(SHRINK[draw] * own + (1 - SHRINK[draw]) * F.col("cohort"))
    moved = base * (F.pow("supply", F.lit(supply_power)) if supply_power else F.lit(1.0))
    pred = F.greatest(F.lit(3), F.floor(moved + 0.5)).cast("int")
    width = _band(F.col("grp"), draw) * F.when(own.isNull(), 1.3).otherwise(1.0)
    out = t.withColumn("pred", F.when(base.isNotNull(), pred)).withColumn("_w", width).withColumn("method", F.when(base.isNull(), None).when(own.isNull(), "cohort").otherwise("history"))
    return out.select("horizon", "ed_id", "grp", "yr", F.col("cut").alias("actual"), "last", "pred", F.greatest(F.lit(1), F.floor(F.col("pred") * (1 - F.col("_w")) + 0.5).cast("int")).alias("low"), F.floor(F.col("pred") * (1 + F.col("_w")) + 0.5).cast("int").alias("high"), "method", *(["drift", "regional"] if factors else []))


def backtest(obs: DataFrame, draw: str, horizons: list[int]) -> DataFrame:
    """Error, baseline error, win rate and coverage by horizon, by group and by season, walk-forward over every observation."""
    out = predict_horizons(obs, draw, horizons)
    inside = F.avg((F.col("actual").between(F.col("low"), F.col("high"))).cast("int")).alias("coverage")
    return aggregates.slice_summary(out.where("pred is not null"), [["horizon"], ["horizon", "grp"], ["horizon", "yr"]], [*aggregates.error_metrics("pred", "last", "actual"), inside])


def error_quantiles(obs: DataFrame, draw: str, horizons: list[int], ps: dict[str, float]) -> DataFrame:
    """``horizon, grp`` and the absolute error at each share of ``ps``, not interpolated."""
    out = predict_horizons(obs, draw, horizons).where("pred is not null and actual is not null")
    return ranks.nearest_quantiles(out.withColumn("e", F.abs(F.col("pred") - F.col("actual"))), ["horizon", "grp"], "e", ps)


def grid_search(preds: DataFrame, factors: DataFrame | None, grid: list[float]) -> DataFrame:
    """Mean absolute error of pred * a^x * b^y for each (x, y); the smallest first, then the smallest powers. a and b are columns of
    ``factors`` (by ed_id), or of ``preds`` itself without it."""
    points = preds.sparkSession.createDataFrame([(float(x), float(y)) for x in grid for y in grid], "x double, y double")
    err = F.abs(F.col("actual") - F.col("pred") * F.pow("a", F.col("x")) * F.pow("b", F.col("y")))
    rows = preds if factors is None else preds.join(factors, "ed_id")
    return rows.crossJoin(F.broadcast(points)).groupBy("x", "y").agg(F.avg(err).alias("mae")).orderBy("mae", "x", "y")


#: The draw that each key of BLEND stands for.
DRAWS = {"ms": ("singles", "main"), "qs": ("singles", "qualifying"), "md": ("doubles", "main")}


def upcoming(editions: DataFrame, as_of: Column, weeks: int) -> DataFrame:
    """Editions that start within ``weeks`` weeks, with the horizon in weeks, rounded up, and the ``draws`` of their level."""
    days = F.datediff("start_date", as_of)
    lv = F.lower("level")
    draws = F.when(lv == "grand slam qualifying", F.array(F.lit("qs"))).when(lv == "grand slam", F.array(F.lit("ms"), F.lit("md"))).otherwise(F.array(F.lit("ms"), F.lit("qs"), F.lit("md")))
    return editions.where(days.between(0, 7 * weeks)).withColumn("horizon", F.ceil(days / 7).cast("int")).withColumn("draws", draws)


def job(editions: DataFrame, obs: DataFrame, stored: DataFrame, as_of: Column, weeks: int, now: Column) -> DataFrame:
    """The table of predictions after a run: ``ed_id, ev, dr, horizon, pred, low, high, method, predicted_at``.

    Upcoming editions (ed_id, ent, yr, wk, level, lat, lon, start_date) are predicted for each draw of their level from the observations (the
    same columns, ev, dr and cut) that have no cut for them yet; a prediction replaces the stored one of the same edition, draw and horizon.
    """
    soon = materialise(upcoming(editions, as_of, weeks), "upcoming")
    columns = ["ed_id", "ent", "yr", "wk", "level", "lat", "lon"]
    out = None
    for draw, (ev, dr) in DRAWS.items():
        targets = soon.where(F.array_contains("draws", draw))
        seen = obs.where((F.col("ev") == ev) & (F.col("dr") == dr) & F.col("cut").isNotNull()).select(*columns, "cut").join(targets.select("ed_id"), "ed_id", "left_anti")
        rows = seen.unionByName(targets.select(*columns, F.lit(None).cast(seen.schema["cut"].dataType).alias("cut")))
        got = predict(rows, draw).join(targets.select("ed_id", "horizon"), "ed_id").where("pred is not null")
        one = got.select("ed_id", F.lit(ev).alias("ev"), F.lit(dr).alias("dr"), "horizon", "pred", "low", "high", "method", now.alias("predicted_at"))
        one = materialise(one, "draw-predictions")  # the upcoming editions' rows
        out = one if out is None else out.unionByName(one)
    return merge.upsert(stored, out, ["ed_id", "ev", "dr", "horizon"], "incoming_wins")


def score(preds: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """Fill the actual value and the time of scoring where a prediction is not scored and its value has arrived."""
    both = preds.join(facts.withColumnRenamed("cut", "_cut"), "ed_id", "left")
    arrived = F.col("scored_at").isNull() & F.col("_cut").isNotNull()
    return both.withColumn("actual", F.when(arrived, F.col("_cut")).otherwise(F.col("actual"))).withColumn("scored_at", F.when(arrived, now).otherwise(F.col("scored_at"))).drop("_cut")


def report(preds: DataFrame, slices: list[list[str]]) -> DataFrame:
    return aggregates.slice_summary(preds.where("pred is not null and last is not null"), slices, aggregates.error_metrics("pred", "last", "actual"))
