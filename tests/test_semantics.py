"""Rules that are pinned by known values, invariants and plan shapes."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import dates, geo, levels, text
from tideline.operators import aggregates, chains, joins, merge, quality, ranks, windows
from tideline.operators.graph import connected_components
from tideline.plans import field
from tideline.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_half_up_and_nearest_index(spark):
    assert one(spark, geo.half_up(F.lit(-2.5))) == -2 and one(spark, geo.half_up(F.lit(2.5))) == 3
    assert one(spark, geo.half_up(F.lit(float("nan")))) is None
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)], "g string, x int")
    assert tuple(aggregates.nearest_quantiles(df, ["g"], "x", {"p50": 0.5, "p90": 0.9}).first()) == ("a", 3, 4)


def test_distances_and_places(spark):
    km = one(spark, geo.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278)))
    assert 330 < km < 360
    keys = [one(spark, text.place_key(F.lit(x))) for x in ("San Diego 1, CA", "Bogotá (Los Lagartos)", "Tigre 2")]
    assert keys[1:] == ["bogota", "tigre"] and keys[0].startswith("sandiego")


def test_letters_with_marks_fold(spark):
    for raw, key in (("Łódź", "lodz"), ("Đà Nẵng", "danang"), ("Székesfehérvár", "szekesfehervar"), ("Plzeň", "plzen"), ("Żory-Ostrów", "zoryostrow"), ("Hódmezővásárhely", "hodmezovasarhely"), ("Quảng Ngãi", "quangngai"), ("São Paulo", "saopaulo")):
        assert one(spark, text.city_key(F.lit(raw))) == key


def placed(spark, rows):
    """Events (ed_id, level[, changes]) of one week in one place on clay."""
    base = {"yr": 2026, "wk": 36, "lat": 41.9, "lon": 12.5, "surface": "Clay", "indoor": False, "draw_size": None}
    full = [{**base, "ed_id": i, "level": lv, **dict(more[0] if more else {})} for i, lv, *more in rows]
    return spark.createDataFrame(full, "ed_id long, level string, yr int, wk int, lat double, lon double, surface string, indoor boolean, draw_size int")


def depths(df, discipline="singles"):
    return {r.ed_id: round(r.depth, 6) for r in field.depth(df, discipline).collect()}


def test_depth_counts_what_events_above_absorb(spark):
    got = depths(placed(spark, [(1, "Challenger 75"), (2, "ATP 250"), (3, "Grand Slam"), (4, "Exhibition"), (5, "Grand Slam Qualifying")]))
    assert got[1] == 25 + 26 + 148 and got[2] == 24 + 148 and got[3] == 104 and got[4] == 0 and got[5] == 104 + 148
    two = depths(placed(spark, [(1, "Challenger 100"), (2, "Challenger 100"), (3, "Challenger 75"), (4, "ATP 1000"), (5, "ATP Finals")]))
    assert two[1] == two[2] == 25 + 25 + 36 and two[3] == 25 + 25 + 25 + 36 and two[4] == 43 and two[5] == 0
    later = depths(placed(spark, [(1, "Challenger 75", {"wk": 37}), (2, "Challenger 75", {"wk": 38}), (3, "Challenger 75", {"wk": 39}), (4, "Grand Slam")]))
    assert (later[1], later[2], later[3]) == (25 + 74, 25 + 37, 25)
    weights = depths(placed(spark, [(1, "Challenger 75"), (2, "Challenger 75", {"surface": "Grass"}), (3, "Challenger 75", {"indoor": True}), (4, "Challenger 75", {"draw_size": 48, "lat": None})]))
    assert weights[1] == round(25 + 25 * 0.3 + 25 * 0.85, 6) and weights[2] == 25 + 2 * 25 * 0.3 and weights[4] == 41
    pairs = depths(placed(spark, [(1, "Challenger 75"), (2, "ATP 500")]), "doubles")
    assert pairs == {1: 14 + 16, 2: 14}


def test_contributions_add_up_to_depth(spark):
    import random

    rng = random.Random(3)
    names = ["Grand Slam", "ATP 1000", "ATP 250", "Challenger 125", "Challenger 75", "ITF M25", "Exhibition", "Grand Slam Qualifying"]
    df = placed(spark, [(k, rng.choice(names), {"wk": rng.randint(30, 33), "lat": rng.choice([10.0, 11.5, 48.0, None]), "lon": float(rng.randint(0, 3)), "surface": rng.choice(["Clay", "Hard", "Grass", "Carpet"]), "indoor": rng.choice([None, True, False])}) for k in range(120)])
    sums = {}
    for r in field.contributions(df).collect():
        sums[r.ed_id] = sums.get(r.ed_id, 0) + r.contribution
    for r in field.depth(df).collect():
        assert r.others == pytest.approx(sums.get(r.ed_id, 0), abs=1e-9)


def test_deadlines_of_slams(spark):
    e = spark.createDataFrame([(1, "Grand Slam", "2026-08-31"), (2, "Grand Slam Qualifying", "2026-08-24"), (3, "ATP 250", "2026-03-18"), (4, "ITF M25", "2026-01-15"), (5, "Exhibition", "2026-01-15")], "ed_id long, level string, d string").withColumn("start_date", F.to_date("d"))
    got = {(r.ed_id, r.kind): r for r in field.deadlines(e).collect()}
    assert {k for k, _ in got} == {1, 3, 4} and len(got) == 7
    day = dt.date.fromisoformat
    assert got[1, "main"].due == day("2026-07-20") and got[1, "main"].qualifying_due == day("2026-08-03") and got[1, "qualifying"].qualifying_due is None
    assert got[3, "main"].due == day("2026-02-16") and got[3, "main"].due_at == dt.datetime(2026, 2, 16, 17) and got[1, "main"].due_at.hour == 16
    assert got[4, "entry"].due_at == dt.datetime(2025, 12, 25, 14) and got[4, "entry"].time_note == "14:00 GMT (Thu)"


def test_week_view_takes_the_nearest_week(spark):
    df = placed(spark, [(1, "Challenger 75"), (2, "ATP 250"), (3, "Challenger 75", {"lat": -30.0, "lon": -60.0}), (4, "Challenger 75", {"wk": 30})])
    cuts = spark.createDataFrame([(1, 300)], "ed_id long, last_cut int")
    got = {r.ed_id: r for r in field.week_view(df, cuts, 2026, 35).collect()}
    assert set(got) == {1, 2, 3} and {r.week for r in got.values()} == {36}
    assert (got[1].places, got[1].rank, got[1].region, got[1].last_cut) == (52, 1, "Europe", 300) and got[2].rank == 2 and got[3].region == "South America"
    assert got[1].reasons.startswith("absorption:2") and got[1].competing == 2 and got[2].competing == 0
    assert field.nearest_week(df, 2026, 33) == 30 and field.nearest_week(df, 2030, 7) == 7


def test_spread_joins_equal_plain_joins(spark):
    from tideline.operators import spread

    many = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(3000)] + [(None, -1)], "key int, row int")
    few = spark.createDataFrame([(k, f"v{k}") for k in range(0, 3000, 2)] + [(1, "hot")], "key int, value string")
    assert spread.hot_keys(many, ["key"]).count() == 1
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = spread.spread_join(many, few, ["key"], F.col("row"), how)
        assert sorted(map(str, got.collect())) == sorted(map(str, many.join(few, "key", how).collect()))


def test_links_have_the_components_of_all_edges(spark):
    import random

    rng = random.Random(8)
    rows = [(k, 2020, rng.randint(1, 6), rng.choice("ABCD"), "r", rng.choice(["Clay", "Hard"]), float(rng.randint(0, 4)), float(rng.randint(0, 4))) for k in range(150)]
    e = spark.createDataFrame(rows, "ed_id long, yr int, wk int, country string, region string, surface string, lat double, lon double")
    near = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "D"), ("D", "C")], "a string, b string")
    whole = connected_components(joins.adjacency_edges(e, near, 250))
    assert sorted(map(tuple, connected_components(joins.adjacency_links(e, near, 250)).collect())) == sorted(map(tuple, whole.collect()))


def test_components_raise_when_rounds_run_out(spark):
    with pytest.raises(RuntimeError):
        connected_components(spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), max_rounds=1)


def test_late_rows_within_the_watermark_count_and_later_ones_are_dropped(spark, tmp_path):
    """Three files arrive one by one; event time decides, and what is older than the watermark at its arrival is left out."""
    from tideline.streaming import jobs

    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    for k, rows in enumerate([[(day(1), "a", 1), (day(10), "a", 2)], [(day(9), "b", 3), (day(11), "b", 4)], [(day(2), "c", 5), (day(11, 5), "c", 6)]]):
        spark.createDataFrame(rows, "ts timestamp, event_type string, event_id long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("ts timestamp, event_type string, event_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = {r.event_id for r in jobs.run_to_table(jobs.movement_ledger(stream, ["event_id"], "ts", "3 days"), "late-test").collect()}
    assert got == {1, 2, 3, 4, 6}


def test_mondays_and_seasons(spark):
    for day, monday in (("2026-03-16", "2026-03-16"), ("2026-03-18", "2026-03-16"), ("2026-03-15", "2026-03-09")):
        assert one(spark, dates.monday_of(F.lit(day).cast("date"))) == dt.date.fromisoformat(monday)
    assert one(spark, dates.season_of(F.lit("2025-12-29").cast("date"))) == 2026
    assert one(spark, dates.friday_before(F.lit("2026-03-20").cast("date"))) == dt.date(2026, 3, 13)


def test_levels_order(spark):
    names = ["Grand Slam", "ATP Finals", "ATP 1000", "ATP 500", "ATP 250", "Challenger 175", "Challenger 125", "Challenger 75", "ITF M25", "ITF M15", "Other"]
    ranks = [one(spark, levels.level_rank(F.lit(n))) for n in names]
    assert ranks == sorted(ranks, reverse=True) and ranks[-1] == 0


def test_prior_period_needs_exactly_one_step(spark):
    df = spark.createDataFrame([(1, 2020, 5), (1, 2021, 6), (1, 2023, 7)], "k int, yr int, v int")
    assert {(r.yr, r.prev) for r in joins.prior_period(df, ["k"], "yr", "v", "prev").collect()} == {(2020, None), (2021, 5), (2023, None)}


def test_as_of_takes_equal_times_and_nothing_later(spark):
    left = spark.createDataFrame([(1, 10), (1, 4), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 10, "b"), (1, 11, "c")], "k int, s int, v string")
    assert {(r.k, r.t, r.asof_v) for r in joins.as_of(left, right, ["k"], "t", "s", ["v"]).collect()} == {(1, 10, "b"), (1, 4, None), (2, 1, None)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_equal_union_find(spark, pairs):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {(r.node, r.component) for r in got} == {(a, find(a)) for a in list(root)}


def test_components_of_a_long_path(spark):
    got = connected_components(spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert got.where("component = 0").count() == 301


@pytest.mark.parametrize("policy", merge.POLICIES)
def test_upsert_is_idempotent(spark, policy):
    a = spark.createDataFrame([(1, None, 2), (2, 3, None)], "k int, x int, y int")
    b = spark.createDataFrame([(2, None, 5), (3, 6, 7)], "k int, x int, y int")
    once = merge.upsert(a, b, ["k"], policy)
    assert sorted(merge.upsert(once, b, ["k"], policy).collect()) == sorted(once.collect())
    assert once.count() == 3
    with pytest.raises(ValueError):
        merge.upsert(a, b, ["k"], "other")


def test_ledger_transitions(spark):
    cases = spark.createDataFrame([("a", "R", "open", 1, 2), ("b", "R", "fixed", 1, 2), ("c", "S", "open", 1, 0), ("d", "R", "open", 1, 0)], "key string, rule string, status string, times_seen int, attempts int")
    found = spark.createDataFrame([("a", "R"), ("b", "R"), ("e", "R")], "key string, rule string")
    state, log = quality.sync_ledger(cases, found, ["R"], F.current_timestamp())
    assert {r.key: (r.status, r.times_seen, r.attempts) for r in state.collect()} == {"a": ("open", 2, 2), "b": ("open", 2, 0), "c": ("open", 1, 0), "d": ("fixed", 1, 0), "e": ("open", 1, 0)}
    assert {r.key: r.event for r in log.collect()} == {"a": "seen", "b": "reopened", "d": "fixed", "e": "opened"}


def test_cohort_score_ties_half_and_small_cohorts(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 2, 4, 5, 6, 7, 8)] + [("b", 1)], "c string, v int")
    got = {(r.c, r.v): r.score for r in ranks.cohort_score(df, "c", "v").collect()}
    assert got["a", 1] == 100 * 7.5 / 8 and got["a", 2] == 100 * 6 / 8 and got["b", 1] is None


def test_movement_notes_and_missing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "OUT: A, B IN: C, D Next: E"), (2, "IN: Z"), (3, None)], "id int, note string")
    got = {(r.id, r.kind, r.player) for r in readers.parse_movements(df, "id", "note").collect()}
    assert got == {(1, "withdrawal", "A"), (1, "withdrawal", "B"), (1, "promotion", "C"), (1, "promotion", "D"), (1, "reported-next", "E"), (2, "promotion", "Z")}
    (tmp_path / "x.csv").write_text('a,b\n"1","x, y"\nz,q\n')
    assert [tuple(r) for r in readers.load_csv(spark, str(tmp_path), {"a": "int", "b": "string"}).collect()] == [(1, "x, y")]
    with pytest.raises(ValueError, match="missing columns: c"):
        readers.load_csv(spark, str(tmp_path), {"c": "int"})


def test_joins_are_equi_joins(spark):
    """No nested loop and no cartesian product in the spatial, interval and depth plans."""
    e = spark.createDataFrame([(1, 2020, 3, 10.0, 20.0, "ATP 250", "Clay")], "ed_id long, yr int, wk int, lat double, lon double, level string, surface string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from tideline.plans import projection

        o = e.selectExpr("*", "1L as ent", "'tour' as grp", "300 as cut")
        for df in (joins.near_in_time_space(e, e, ["yr"], "wk", [-1, 0, 1], 800), field.depth(e), field.drain(e), projection.level_medians(o), projection.cohort_base(o), projection.season_drift(o), projection.regional_drift(o)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_near_in_time_space_equals_brute_force(spark):
    import itertools
    import math
    import random

    rng = random.Random(4)
    pts = [(k, 2020 + k % 2, rng.randint(1, 5), rng.uniform(-80, 80), rng.uniform(-180, 180)) for k in range(120)]
    df = spark.createDataFrame(pts, "ed_id long, yr int, wk int, lat double, lon double")

    def km(a, b):
        p, q = math.radians(a[3]), math.radians(b[3])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    want = {(a[0], b[0]) for a, b in itertools.product(pts, pts) if a[1] == b[1] and abs(a[2] - b[2]) <= 1 and km(a, b) <= 3000}
    got = {(r.ed_id, r.r_ed_id) for r in joins.near_in_time_space(df, df, ["yr"], "wk", [-1, 0, 1], 3000).collect()}
    assert got == want


def brute_pieces(weeks, max_weeks):
    """Weeks (week to its events' places) cut as often as needed at the largest jump, the first of equals."""
    order = sorted(weeks)
    if len(order) <= max_weeks or len(order) < 4:
        return [order]
    mean = {w: [sum(p[k] for p in weeks[w]) / len(weeks[w]) for k in (0, 1)] for w in order}

    def jump(p):
        (a, b), (c, d) = (map(math.radians, mean[order[p + k]]) for k in (0, 1))
        return round(2 * 6371 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))), 6)

    best = max(range(1, len(order) - 2), key=lambda p: (jump(p), -p))
    return [piece for half in (order[: best + 1], order[best + 1 :]) for piece in brute_pieces({w: weeks[w] for w in half}, max_weeks)]


def test_long_chains_are_cut_until_every_part_fits(spark):
    """Chain 1 has its largest jumps at its start, so that each cut peels off two weeks; chain 2 ends with weeks in one city."""
    places, lat = {}, -40.0
    for w in range(1, 54):
        lat += (60 - w) / 20 if w % 2 else 0.001
        places[1, w] = [(lat, 2.0)]
    places |= {(2, w): [(10.0 + w, 5.0)] if w < 7 else [(30.0, 5.0)] for w in range(1, 13)}
    places |= {(3, w): [(30.0, 9.0)] for w in range(1, 15)}
    places |= {(4, w): [(10.0, 5.0), (11.0 + w % 3, 5.0 + w * w % 7)] for w in range(3, 30)}
    events = [(c * 1000 + 10 * w + k, w, "C%d" % c, a, b) for (c, w), ps in places.items() for k, (a, b) in enumerate(ps)]
    e = spark.createDataFrame(events, "ed_id long, wk int, country string, lat double, lon double").selectExpr("*", "1999 as yr", "'r' as region", "'Clay' as surface")
    none = spark.createDataFrame([], "a string, b string")
    got = {}
    for r in chains.chains(e, none, max_weeks=4).collect():
        got.setdefault((r.ed_id // 1000, r.part, r.kind), set()).add(r.ed_id)
    want = {}
    for c in (1, 2, 3, 4):
        weeks = {w: ps for (d, w), ps in places.items() if d == c}
        lone = len({p for ps in weeks.values() for p in ps}) == 1
        for part, piece in enumerate([sorted(weeks)] if lone else brute_pieces(weeks, 4)):
            cities = {p for w in piece for p in weeks[w]}
            want[c, part, "series" if len(cities) == 1 and len(piece) > 3 else "swing"] = {i for i, w, country, _, _ in events if country == "C%d" % c and w in piece}
    assert got == want
    assert max(k[1] for k in got if k[0] == 1) > 20 and (2, "series") in {(k[0], k[2]) for k in got}
