"""Thresholds ('cuts') as column expressions: lower is stronger."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def legacy_cut(ev: Column, direct: Column, alternate: Column, advanced: Column) -> Column:
    return F.when(ev == "doubles", F.coalesce(advanced, alternate, direct)).otherwise(F.coalesce(alternate, direct))


def direct_cut(ev: Column, direct: Column, advanced: Column) -> Column:
    return F.when(ev == "doubles", F.coalesce(advanced, direct)).otherwise(direct)


def open_draw(byes: Column, *ranks: Column) -> Column:
    return (F.coalesce(byes, F.lit(0)) > 0) & F.coalesce(*ranks).isNull()


def has_cut(byes: Column, *ranks: Column) -> Column:
    return F.coalesce(*ranks, byes).isNotNull()


def saturated(cut: Column, ev: Column) -> Column:
    return cut.isNull() | (cut > F.when(ev == "doubles", 500).otherwise(600))


def min_plausible(level: Column, ev: Column, dr: Column) -> Column:
    two = ev == "doubles"
    return (
        F.when(dr == "qualifying", 30)
        .when(F.contains(level, F.lit("Slam")), F.when(two, 20).otherwise(30))
        .when(F.contains(level, F.lit("1000")), F.when(two, 20).otherwise(25))
        .when(F.contains(level, F.lit("500")), F.when(two, 20).otherwise(15))
        .when(F.contains(level, F.lit("250")), F.when(two, 20).otherwise(10))
        .when(level.startswith("Challenger"), 50)
        .otherwise(5)
    )


def garbage_rule(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that fires, else null."""
    return F.coalesce(*(F.when(test, F.lit(name)) for name, test in rules))


#: Patterns of names that are no players (upper case is not told apart where marked).
JUNK_NAMES = [
    ("digits", r"^\s*\d+\s*$"), ("currency", "€|\\$|£"), ("prize money", r"(?i)PRIZE\s*MONEY"), ("first round", r"(?i)FIRST\s*ROUND"), ("seeded", r"(?i)SEEDED\s*(PLAYERS|TEAMS)"),
    ("supervisor", r"(?i)CHALLENGER\s*SUPERVISOR"), ("challenger", r"(?i)^CHALLENGER\b"), ("open", r"(?i)\bOPEN\b"), ("masters", r"(?i)\bMASTERS\b"), ("citta", r"(?i)\bCITTA\b"), ("indoor", r"(?i)\bINDOOR\b"),
    ("finalist", r"(?i)(QUARTER|SEMI)[\s-]FINALIST"), ("label", r"(?i)^LAST\s+DIRECT\s+ACCEPTANCE"), ("combined", r"[A-Z]\+[A-Z]"), ("code", r"(?i)^(WC|LL|SE|PR|WR|Alt)$"), ("score", r"^\d{2}(\s+\d{1,3})+$"),
]


def garbage(rank: Column, name: Column, manual: Column, *protected: Column) -> Column:
    """The first sign that a stored rank was misread, else null: a year without a player's name, an impossible rank, or a name that is none.
    Rows entered by hand, and rows with one of the ``protected`` ranks, never show one."""
    player = F.coalesce(name, F.lit("")).rlike("[A-Za-z]")
    rules = [("year", rank.between(1900, 2100) & ~player), ("too high", rank > 5000), ("too low", rank < 3)]
    rules += [(label, name.rlike(pattern)) for label, pattern in JUNK_NAMES]
    kept = F.coalesce(manual, F.lit(False))
    for p in protected:
        kept = kept | p.isNotNull()
    return F.when(~kept, garbage_rule(rules))
