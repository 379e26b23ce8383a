"""Classification of event levels. Tables of fixed values stand under their own comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern of a lower-case level and its rank, in the order of the tests.
RANKS = [
    ("grand slam", 100), ("finals", 95), (r"atp\s*1000", 90), (r"atp\s*500", 80), (r"atp\s*250", 70),
    (r"challenger\s*175", 60), (r"challenger\s*125", 55), (r"challenger\s*100", 50), (r"challenger\s*80", 47), (r"challenger\s*75", 45), (r"challenger\s*50", 40), ("challenger", 35),
    ("m25|itf.*25", 20), ("m15|itf.*15", 15), ("itf", 10),
]
#: Lowest rank, default direct-acceptance slots in singles and doubles.
SLOTS = [(100, 104, 60), (95, 0, 0), (90, 43, 22), (80, 24, 14), (70, 24, 14), (35, 25, 14), (10, 24, 14)]
#: Lowest rank and reserved places in a singles draw.
RESERVED = [(100, 24), (90, 13), (70, 8), (0, 7)]
#: Lowest rank, absorbed entries in singles and doubles; nothing is absorbed at rank 60 or below.
ABSORPTION = [(100, 148, 64), (95, 0, 0), (90, 36, 24), (80, 24, 16), (70, 26, 16)]
#: The share of the absorption that is left in each further week.
DECAY = [1.0, 0.5, 0.25]


def _ladder(rank: Column, steps, column: int, default=0) -> Column:
    out = F.lit(default)
    for step in reversed(steps):
        out = F.when(rank >= step[0], F.lit(step[column])).otherwise(out)
    return out


def level_rank(level: Column) -> Column:
    out = F.lit(0)
    for pattern, rank in reversed(RANKS):
        out = F.when(F.lower(level).rlike(pattern), rank).otherwise(out)
    return out


def level_group(level: Column) -> Column:
    return F.when(level.startswith("ITF"), "itf").when(level.startswith("Challenger"), "challenger").when(level.startswith("ATP") | F.contains(level, F.lit("Slam")), "atp")


def tier_group(level: Column) -> Column:
    """gs, tour or challenger; null for others."""
    return F.when(F.contains(level, F.lit("Slam")), "gs").when(level.startswith("ATP"), "tour").when(level.startswith("Challenger"), "challenger")


def category(level: Column) -> Column:
    return F.when(F.contains(level, F.lit("Slam")), "slam").when(level.startswith("ATP"), "tour").when(level.startswith("Challenger"), "challenger").when(level.startswith("ITF"), "itf")


def is_slam_qualifying(level: Column) -> Column:
    return F.lower(F.trim(level)).startswith("grand slam qualifying")


def supply_weight(level: Column) -> Column:
    rank = level_rank(level)
    return F.when(rank >= 90, 3.0).when(rank >= 70, 2.0).when(rank >= 35, 1.0).otherwise(0.5)


def da_slots(level: Column, draw_size: Column, discipline: str = "singles") -> Column:
    """Struct of the slots and their source: the actual singles draw less reserved places, else the level's default; an
    unknown level has none."""
    rank = level_rank(level)
    reserved = _ladder(rank, RESERVED, 1)
    default = _ladder(rank, SLOTS, 2 if discipline == "doubles" else 1)
    actual = (rank > 0) & draw_size.isNotNull() & (draw_size > reserved) if discipline == "singles" else F.lit(False)
    return F.struct(F.when(actual, draw_size - reserved).otherwise(default).cast("int").alias("slots"), F.when(actual, "actual").otherwise("default").alias("source"))


def absorption_slots(level: Column, week_offset: Column, discipline: str = "singles") -> Column:
    rank = level_rank(level)
    whole = F.when(rank > 60, _ladder(rank, ABSORPTION, 2 if discipline == "doubles" else 1)).otherwise(0)
    return whole * F.coalesce(F.get(F.array(*map(F.lit, DECAY)), week_offset), F.lit(0.0))


def reach_weeks(level: Column) -> Column:
    return F.when(level_rank(level) >= 100, 3).otherwise(1)


def exposure(level: Column) -> Column:
    """How much a lower-tier event nearby drains the field."""
    rank = level_rank(level)
    return F.when((rank > 0) & (rank <= 45), "high").when(rank.between(46, 60), "low").otherwise("none")


#: What ``surface_family`` can give.
FAMILIES = ["clay", "grass", "hard"]


def surface_family(surface: Column) -> Column:
    s = F.lower(F.trim(surface))
    return F.when(F.contains(s, F.lit("clay")), "clay").when(F.contains(s, F.lit("grass")), "grass").otherwise("hard")


def is_indoor(surface: Column, indoor: Column) -> Column:
    """As flagged; unflagged events are indoors on carpet only."""
    return F.coalesce(indoor, F.contains(F.lower(surface), F.lit("carpet")), F.lit(False))


def w_surface(a: Column, b: Column, indoor_a: Column, indoor_b: Column) -> Column:
    """1 for the same surface and roof, 0.85 for the same surface, 0.3 if one is grass, else 0.55."""
    fa, fb = surface_family(a), surface_family(b)
    return F.when((fa == fb) & (indoor_a == indoor_b), 1.0).when(fa == fb, 0.85).when((fa == "grass") | (fb == "grass"), 0.3).otherwise(0.55)
