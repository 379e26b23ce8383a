"""Every registered query of the core library against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tideline.plans import catalog, registry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def engine(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in catalog.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def oracle():
    return engine(SF)


@pytest.fixture(scope="session")
def larger():
    return engine(LARGER)


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


def check_equal(spark, con, folder, name):
    df = registry.queries()[name](spark, folder)
    got = table([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = table(cur.fetchall(), names)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(math.isclose(a, b, abs_tol=2e-5) if isinstance(a, float) and isinstance(b, float) else a == b for a, b in zip(g, w, strict=True)), (g, w)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    check_equal(spark, oracle, SF, name)


#: Queries with rules that the smallest tables do not reach.
RARE = [
    "c04_best_match", "c05_scored_match", "c05_e03_mutual_best", "c07_prior_reference", "c13_token_match", "d04_nearest_quantiles", "d05_correlation", "e05_cohort_score", "e08_visible_pairs", "j05_supply", "j21_schedule", "j35_phase_and_label",
    "l04_blocked_merges", "l05_l07_audit", "l12_ledger_log", "l19_sweep_status", "l20_audit_levels", "m10_promote_metadata", "n05_trajectory", "n07_stream_due", "n12_classify_notes",
]


@pytest.mark.parametrize("name", RARE)
def test_query_equals_sql_on_more_rows(spark, larger, name):
    check_equal(spark, larger, LARGER, name)


#: Every label that a result can have, by query and column.
LABELS = {
    ("c05_scored_match", "score"): {100, 95, 90, 80, 78, 76, 70, 68, 66},
    ("j35_phase_and_label", "phase"): {"past", "current", "upcoming"},
    ("l04_blocked_merges", "blocked"): {"country", "name", "level", None},
    ("l05_l07_audit", "rule"): {"A1", "A2", "A3", "A4", "A5", "C1", "C10", "C12", "C2", "C7", "C9", "S1"},
    ("l08_holiday_weeks", "severity"): {"warn", "ok"},
    ("l12_ledger_log", "event"): {"opened", "reopened", "seen", "fixed"},
    ("l16_invalid_combos", "problem"): {"doubles qualifying", "exhibition"},
    ("l19_sweep_status", "reason"): {"stale", "discontinued", "cancelled", "restored", None},
    ("l20_audit_levels", "verdict"): {"confirmed", "mismatch", "unverifiable", "missing code"},
    ("n04_derive_state", "state"): {"withdrawn", "accepted", "alternate"},
    ("n08_two_phase", "state"): {"sent", "released"},
    ("n12_classify_notes", "resolved"): {True, False},
}


@pytest.mark.parametrize("name,column", sorted(LABELS))
def test_every_label_occurs(larger, name, column):
    found = larger.execute(f"SELECT DISTINCT {column} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert {r[0] for r in found} == LABELS[name, column]


def test_labels_of_saved_events(larger):
    found = {r[0] for r in larger.execute(f"SELECT DISTINCT label FROM ({registry.oracle_sql()['j35_phase_and_label']})").fetchall()}
    assert {"Dates TBD", "This week", "Next week", "Last week", "Last year", "In 2 weeks", "In 2 months", "2 weeks ago", "2 years ago"} <= found


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_no_query_is_empty(larger, name):
    assert larger.execute(f"SELECT count(*) FROM ({registry.oracle_sql()[name]})").fetchone()[0] > 0


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
