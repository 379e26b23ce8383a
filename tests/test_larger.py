"""Tables repeated with shifted keys, or made for one rule, against SQL."""

import os

import duckdb
import pytest
from test_queries import SF, check_equal, engine

from tideline.plans import catalog

#: Key columns by table; a copy's keys are shifted beyond the largest.
KEYS = {"customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"]}
TOP = {"c_custkey": 1_000, "o_custkey": 1_000, "s_suppkey": 1_000, "p_partkey": 10_000, "o_orderkey": 100_000}


@pytest.fixture
def folder(tmp_path):
    """Makes a folder of all tables: those named are replaced by SQL, of which ``{t}`` is the smallest table itself."""

    def make(**replaced):
        for t in catalog.TABLES:
            if t in replaced:
                duckdb.sql(replaced[t].replace("{t}", f"'{SF}/{t}.parquet'")).write_parquet(f"{tmp_path}/{t}.parquet")
            else:
                os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
        return str(tmp_path)

    return make


@pytest.fixture
def copies(folder):
    """A folder whose customers, suppliers, parts and orders are repeated ``n`` times."""
    return lambda n: folder(**{t: f"SELECT * EXCLUDE (k) REPLACE ({', '.join(f'{c} + k * {TOP[c]} AS {c}' for c in cols)}) FROM {{t}}, (SELECT unnest(range({n})) AS k)" for t, cols in KEYS.items()})


def test_search_rounds_distances_as_sql_does(spark, folder):
    made = folder(customer="SELECT * REPLACE (CAST(c_nationkey % 2 AS INTEGER) AS c_nationkey, c_custkey % 60 / 8 AS c_acctbal) FROM {t}")
    check_equal(spark, engine(made), made, "b09_search")


def test_members_of_chains_are_those_of_all_edges(spark):
    import random

    from pyspark.sql import functions as F

    from tideline.operators import chains, joins
    from tideline.operators.graph import connected_components

    rng = random.Random(3)
    at = lambda: float(rng.randint(0, 4)) if rng.random() < 0.9 else None
    rows = [(k, 2020 + k % 2, rng.randint(1, 9), rng.choice(["A", "B", "C", "D", None]), rng.choice("rq"), rng.choice(["Clay", "Hard"]), at(), at()) for k in range(150)]
    e = spark.createDataFrame(rows, "ed_id long, yr int, wk int, country string, region string, surface string, lat double, lon double")
    near = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "D")], "a string, b string")
    whole = connected_components(joins.adjacency_edges(e, near, 250))
    got = chains.chain_members(e, near, 250)
    assert sorted(map(tuple, got.select("ed_id", "chain").collect())) == sorted(map(tuple, whole.collect()))
    assert got.where(F.col("lat").isNull()).count() > 0
    assert sorted(map(str, got.drop("chain").collect())) == sorted(map(str, e.join(whole.select(F.col("node").alias("ed_id")), "ed_id").select(got.drop("chain").columns).collect()))


def test_links_grow_with_weeks_and_not_with_pairs(spark):
    """400 events of 40 places in a week and country: all pairs would be 160,000 for two weeks."""
    from tideline.operators import joins

    e = spark.range(2000).selectExpr("id as ed_id", "2020 as yr", "cast(id % 5 + 1 as int) as wk", "'A' as country", "'r' as region", "'Clay' as surface", "cast(id % 40 as double) as lat", "1D as lon")
    none = spark.createDataFrame([], "a string, b string")
    assert joins.adjacency_links(e, none).count() == 4 + 2000


@pytest.mark.parametrize("name", ["d22_chain_summary", "k01_chain_labels"])
def test_chains_are_found_without_pairs_of_events(spark, copies, monkeypatch, name):
    from tideline.operators import joins

    monkeypatch.setattr(joins, "adjacency_edges", None)
    made = copies(3)
    check_equal(spark, engine(made), made, name)


def test_clusters_are_those_of_all_near_pairs(spark, monkeypatch):
    import math
    import random

    from tideline.operators import chains

    rng = random.Random(5)
    place = lambda: (rng.choice([None, *(x / 2 for x in range(-170, 170))]), rng.choice([-179.5, 179.5, *(x / 2 for x in range(-60, 60))]))
    rows = [(k, 2020 + k % 2, k % 3, *place()) for k in range(400)] + [(400 + k, 2020, 0, 50.0, 10.0) for k in range(40)]
    e = spark.createDataFrame(rows, "ed_id long, yr int, wk int, lat double, lon double")

    def km(a, b):
        la, lb, d = math.radians(a[3]), math.radians(b[3]), math.radians(b[4] - a[4])
        return 2 * 6371 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(d / 2) ** 2))

    root = {r[0]: r[0] for r in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1:3] == b[1:3] and None not in (a[3], b[3]) and km(a, b) <= 900:
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    sizes = []
    real = chains.connected_components
    monkeypatch.setattr(chains, "connected_components", lambda links, *a: (sizes.append(links.count()), real(links, *a))[1])
    assert {r.ed_id: r.cluster for r in chains.cluster_within(e, ["yr"], "wk", 900).collect()} == {k: find(k) for k in root}
    assert sizes[0] < 400


def test_near_medians_equal_brute_force(spark, monkeypatch):
    import math
    import random
    from statistics import median

    from tideline.operators import nearby

    rng = random.Random(9)
    place = lambda: (rng.choice([None, 10.0, 20.5, 31.0, -40.0]), rng.choice([-179.0, 179.0, 0.0, 12.5]))
    spots = list({("gh"[k % 2], k % 20, *place()) for k in range(200)})
    values = [("gh"[k % 2], rng.randint(-3, 21), *place(), rng.choice([None, *map(float, range(40))]), rng.randint(1, 3)) for k in range(900)]

    def km(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1.0, math.sqrt(h)))

    windows, want = {0: [-1, 0, 1], 7: [-4]}, {}
    for g, t, lat, lon in spots:
        for name, offsets in windows.items():
            got = [x for h, u, la, lo, x, f in values for _ in range(f) if h == g and u - t in offsets and x is not None and None not in (la, lat) and km((lat, lon), (la, lo)) <= 3000]
            if got:
                want[name, g, t, lat, lon] = (median(got), len(got))
    s = spark.createDataFrame(spots, "g string, t int, lat double, lon double")
    v = spark.createDataFrame(values, "g string, t int, lat double, lon double, x double, f int")
    for held in (nearby.HELD, 1):  # 1: chunks of a spot, distances found anew
        monkeypatch.setattr(nearby, "HELD", held)
        found = nearby.near_medians(s, v, ["g"], "t", windows, 3000).collect()
        assert {(r.window, r.g, r.t, r.lat, r.lon): (r.median, r.n) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("name", ["j06_predict", "j11_report", "j11_worst", "j09_backtest", "j09_error_quantiles", "j04_cohort_base", "j03_regional_drift"])
def test_predictions_make_no_pairs_of_places(spark, copies, monkeypatch, name):
    from tideline.operators import joins

    monkeypatch.setattr(joins, "near_in_time_space", None)
    made = copies(3)
    check_equal(spark, engine(made), made, name)


@pytest.mark.parametrize("name", ["j09_backtest_horizons", "j10_grid_search", "j07_prediction_job"])
def test_plans_that_the_driver_holds_stay_small(spark, name):
    from tideline.plans import registry

    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert plan.count("\n") < 150, plan.count("\n")


@pytest.mark.parametrize("name", ["j14_validation_changes", "j14_validation_order", "j14_validation_coverage", "j14_validation_held_out", "j14_validation_rank", "j14_validation_curve", "j14_validation_restructured"])
def test_validation_reads_editions_once(spark, name, monkeypatch):
    """The view of editions is made once, and depth makes no rows for pairs of groups."""
    from tideline.plans import catalog, registry

    made = []
    real = catalog.Tables.__getattr__
    monkeypatch.setattr(catalog.Tables, "__getattr__", lambda self, view: (made.append(view), real(self, view))[1])
    df = registry.queries()[name](spark, SF)
    assert made.count("v_ed") == 1
    assert df._jdf.queryExecution().analyzed().toString().count("\n") < 150


@pytest.mark.parametrize("name", ["j17_drain_validation"])
def test_drain_compares_spots_and_not_events(spark, copies, monkeypatch, name):
    from tideline.operators import joins

    real, seen = joins.near_in_time_space, []
    monkeypatch.setattr(joins, "near_in_time_space", lambda left, right, *a: (seen.append((left, right)), real(left, right, *a))[1])
    made = copies(4)
    check_equal(spark, engine(made), made, name)
    for side in seen[0]:
        assert side.count() == side.select("yr", "wk", "lat", "lon").distinct().count()


def test_names_are_matched_once_however_often_they_occur(spark):
    from tideline.operators import joins

    left = spark.createDataFrame([(k, n) for k, n in enumerate(["red bolt", "bolt red", "red", None, "el ring"] * 30)], "a int, name string")
    right = spark.createDataFrame([(k, n) for k, n in enumerate(["new red bolt", "red", None, "Ring El", "bolt"] * 20)], "b int, name string")
    names = joins.matching_names(left.selectExpr("name as x"), right.selectExpr("name as y"))
    assert sorted(map(tuple, names.collect())) == [("bolt red", "new red bolt"), ("el ring", "Ring El"), ("red", "red"), ("red bolt", "new red bolt")]
    got = joins.token_match(left, right, "name", "name")
    assert got.columns == ["a", "name", "r_b", "r_name"] and got.count() == 4 * 30 * 20 == got.distinct().count()


def test_a_strict_key_stands_first_at_any_distance(spark):
    """As in SQL: the same slug 50 days away before the same name 5 days away; with a number in the slug it is no match."""
    from tideline.operators import joins

    kind = "ed_id long, yr int, start_date string, level string, slug string, name string, city string"
    dated = lambda rows: spark.createDataFrame(rows, kind).selectExpr("ed_id", "yr", "cast(start_date as date) as start_date", "level", "slug", "name", "city")
    generic = dated([(1, 2020, "2020-03-01", "Challenger", "ev-abcde", "North qqqqq", "aa"), (2, 2020, "2020-03-01", "Challenger", "ev-vwxyz-3", "South rrrrr", "bb"), (3, 2020, "2020-03-01", "Challenger", "s", "t", "77")])
    exact = dated([(10, 2020, "2020-04-20", "Challenger 75", "ev-abcde", "zz", "cc"), (11, 2020, "2020-03-06", "Challenger 75", "yy", "north qqqqq", "dd"), (12, 2020, "2020-04-20", "Challenger 75", "ev-vwxyz-3", "ww", "ee"),
                   (13, 2020, "2020-03-06", "Challenger 75", "vv", "uu", "77"), (14, 2020, "2020-03-09", "Challenger 75", "rr", "qq", "77")])
    got = {r.gid: (r.x_ed_id, r.rung) for r in joins.ladder_match(generic, exact, by_score=False).collect()}
    assert got == {1: (10, 0), 3: (13, 2)}
