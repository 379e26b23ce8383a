"""Upserts and merges as functions of DataFrames: inputs in, new table out; writing is a separate step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.graph import connected_components

POLICIES = ("incoming_wins", "existing_wins", "coalesce_existing", "coalesce_incoming")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """``target`` after ``updates``: whole rows by winner, or column by column with the winner's nulls filled. Keys are
    unique on both sides; applying the same updates twice changes nothing more."""
    if policy not in POLICIES:
        raise ValueError(policy)
    values = [c for c in target.columns if c not in keys]
    a = target.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in values), F.lit(True).alias("_a"))
    b = updates.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in values), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")

    def value(c: str) -> Column:
        old, new = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        if policy == "incoming_wins":
            return F.when(F.col("_b"), new).otherwise(old)
        if policy == "existing_wins":
            return F.when(F.col("_a"), old).otherwise(new)
        return F.coalesce(old, new) if policy == "coalesce_existing" else F.coalesce(new, old)

    return both.select(*keys, *(value(c).alias(c) for c in values))


def block_preserve(target: DataFrame, updates: DataFrame, keys: list[str], block: list[str], counters: list[str]) -> DataFrame:
    """The incoming block replaces the old one only if it has any value; counters are always refreshed."""
    b = updates.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in [*block, *counters]))
    has = F.coalesce(*(F.col(f"_b_{c}") for c in block)).isNotNull()
    out = target.join(b, keys, "left")
    return out.select(*keys, *(F.when(has, F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) for c in block), *(F.coalesce(f"_b_{c}", c).alias(c) for c in counters))


def source_precedence(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str], official: str) -> DataFrame:
    """Rows of the official source keep their columns."""
    b = updates.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in columns))
    keep = F.col("source") == official
    return target.join(b, keys, "left").select(*keys, "source", *(F.when(keep, F.col(c)).otherwise(F.coalesce(f"_b_{c}", c)).alias(c) for c in columns))


def tombstones(target: DataFrame, misses: DataFrame, keys: list[str], value: str, now: Column, retry_hours: int = 6) -> DataFrame:
    """Mark rows that were looked for and not found: never over a value, and not again within ``retry_hours``."""
    m = misses.select(*keys, F.lit(True).alias("_m"))
    recent = F.coalesce(F.col("looked_at") > now - F.expr(f"interval {retry_hours} hours"), F.lit(False))
    mark = F.col("_m") & F.col(value).isNull() & ~recent
    out = target.join(m, keys, "left")
    return out.withColumn("note", F.when(mark, "NOT_FOUND").otherwise(F.col("note"))).withColumn("looked_at", F.when(mark, now).otherwise(F.col("looked_at"))).drop("_m")


def fill_only(target: DataFrame, updates: DataFrame, keys: list[str], column: str, replace_existing: bool = False) -> DataFrame:
    return upsert(target, updates, keys, "coalesce_incoming" if replace_existing else "coalesce_existing").select(*keys, column)


def resolve_mapping(mapping: DataFrame) -> DataFrame:
    """Chains of merges (a into b, b into c) resolved: every entity of a component maps to its smallest id."""
    return connected_components(mapping, "loser", "winner").select(F.col("node").alias("ent"), F.col("component").alias("to"))


def merge_entities(editions: DataFrame, mapping: DataFrame, min_days: int = 14) -> DataFrame:
    """Move editions to the surviving entity. Editions of the same entity and year that start less than ``min_days``
    apart fold into the earliest (facts that it lacks come from the later ones); those further apart stay distinct."""
    moved = editions.join(resolve_mapping(mapping), "ent", "left").withColumn("ent", F.coalesce("to", "ent")).drop("to")
    w = W.partitionBy("ent", "yr").orderBy("start_date", "ed_id")
    gap = F.coalesce(F.datediff("start_date", F.lag("start_date").over(w)) >= min_days, F.lit(True))
    part = moved.withColumn("_new", gap.cast("int")).withColumn("_event", F.sum("_new").over(w))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("start_date", "ed_id")))
    return part.groupBy("ent", "yr", "_event").agg(F.min_by("ed_id", F.struct("start_date", "ed_id")).alias("ed_id"), F.min("start_date").alias("start_date"), first("cut").alias("cut"), F.count(F.lit(1)).alias("folded")).drop("_event")


def repoint(associations: DataFrame, mapping: DataFrame, user: str) -> DataFrame:
    """User to entity after a merge, without repetitions."""
    return associations.join(resolve_mapping(mapping), "ent", "left").select(user, F.coalesce("to", "ent").alias("ent")).distinct()


def distinct_slugs(editions: DataFrame, slug: str, min_days: int = 14) -> DataFrame:
    """Events of one slug and year at least ``min_days`` apart are distinct: the earliest keeps the slug, later ones get -2, -3."""
    w = W.partitionBy(slug, "yr").orderBy("start_date", "ed_id")
    gap = F.coalesce(F.datediff("start_date", F.lag("start_date").over(w)) >= min_days, F.lit(False)).cast("int")
    n = editions.withColumn("_g", gap).withColumn("_n", F.sum("_g").over(w) + 1)
    return n.withColumn("new_slug", F.when(F.col("_n") == 1, F.col(slug)).otherwise(F.concat(slug, F.lit("-"), F.col("_n").cast("string")))).drop("_g", "_n")


def refile_seasons(editions: DataFrame, season: Column, min_days: int = 14, siblings: int = 4) -> DataFrame:
    """``ed_id, season, action, into``: what to do with rows filed one season late (ITF rows never are).

    move: the right season has no edition of the entity; fold: it has one less than ``min_days`` away (``into`` is its id); split: it has
    a different one, so the row goes to the first sibling slug (-2 to -``siblings``) that is free in that season (``into`` is the slug);
    conflict: no sibling is free. Editions have ed_id, slug, yr, start_date, level.
    """
    wrong = editions.withColumn("season", season).where((F.col("season") == F.col("yr") - 1) & ~F.col("level").startswith("ITF"))
    right = editions.groupBy("slug", F.col("yr").alias("season")).agg(F.min_by(F.struct("start_date", "ed_id"), "ed_id").alias("o"))
    both = wrong.join(right, ["slug", "season"], "left")
    names = F.sequence(F.lit(2), F.lit(siblings))
    asked = both.select("ed_id", "season", F.explode(names).alias("k"), F.concat("slug", F.lit("-"), F.col("k").cast("string")).alias("sibling"))
    free = asked.join(right.select(F.col("slug").alias("sibling"), "season"), ["sibling", "season"], "left_anti").groupBy("ed_id").agg(F.min_by("sibling", "k").alias("sibling"))
    action = F.when(F.col("o").isNull(), "move").when(F.abs(F.datediff("start_date", "o.start_date")) < min_days, "fold").when(F.col("sibling").isNotNull(), "split").otherwise("conflict")
    out = both.join(free, "ed_id", "left").withColumn("action", action)
    into = F.when(F.col("action") == "fold", F.col("o.ed_id").cast("string")).when(F.col("action") == "split", F.col("sibling"))
    return out.select("ed_id", "season", "action", into.alias("into"))


def copy_facts(snaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Facts of ``src`` editions written to ``dst`` editions; incoming wins, the source stays."""
    moved = snaps.join(pairs, snaps["ed_id"] == pairs["src"]).select(F.col("dst").alias("ed_id"), "ev", "dr", "direct_rank")
    return upsert(snaps.select("ed_id", "ev", "dr", "direct_rank"), moved, ["ed_id", "ev", "dr"], "incoming_wins")


def announce_new(current: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows not seen before; the first run (nothing seen) only records a baseline."""
    first = seen.limit(1).count() == 0
    return current.join(seen, key, "left_anti").withColumn("baseline", F.lit(first))


def apply_aliases(df: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Alias to canonical, only where the canonical key exists in ``df``."""
    known = df.select(F.col(key).alias("canonical")).distinct()
    usable = aliases.join(known, "canonical", "left_semi").select(F.col("alias").alias(key), "canonical")
    return df.join(usable, key, "left").withColumn(key, F.coalesce("canonical", key)).drop("canonical")


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with the overridden columns (null in an override: as it was) and ``rewritten``: whether anything differed."""
    o = overrides.select(key, *(F.col(c).alias(f"_o_{c}") for c in columns))
    both = df.join(o, key, "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | (F.col(f"_o_{c}").isNotNull() & ~F.col(f"_o_{c}").eqNullSafe(F.col(c)))
    kept = [F.coalesce(f"_o_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns]
    return both.select(*kept, differs.alias("rewritten"))


def clone_to_year(editions: DataFrame, year: int) -> DataFrame:
    """The newest edition of each entity before ``year``, shifted by whole weeks into it; entities that have one are left out."""
    have = editions.where(F.col("yr") == year).select("ent")
    last = editions.where(F.col("yr") < year).groupBy("ent").agg(F.max_by(F.struct("ed_id", "start_date", "level", "yr"), "yr").alias("e"))
    weeks = (F.lit(year) - F.col("e.yr")) * 52
    return last.join(have, "ent", "left_anti").select("ent", F.lit(year).alias("yr"), F.date_add("e.start_date", weeks * 7).alias("start_date"), F.col("e.level").alias("level"), F.col("e.ed_id").alias("template"))


def upgrade_identity(rows: DataFrame, registry: DataFrame, code: str) -> DataFrame:
    """Name, city and country from the newest registry row of the code; the level only if the row's own is heuristic and the registry's
    is of the tour."""
    facts = ["name", "city", "country"]
    newest = registry.groupBy(code).agg(F.max_by(F.struct(*facts, "level"), "yr").alias("_n"))
    both = rows.join(newest, code, "left")
    level = F.when(F.col("heuristic") & F.col("_n.level").startswith("ATP"), F.col("_n.level")).otherwise(F.col("level"))
    return both.select(*(c for c in rows.columns if c not in (*facts, "level")), *(F.coalesce(F.col(f"_n.{c}"), F.col(c)).alias(c) for c in facts), level.alias("level"))


def recompute_weeks(editions: DataFrame) -> DataFrame:
    """``editions`` (yr, start_date, level, wk) with the week made anew from the date where the edition lies in its season; others keep theirs."""
    from tideline.functions import dates

    fits = F.col("start_date").isNotNull() & dates.in_season(F.col("start_date"), F.col("yr"), F.col("level"))
    return editions.withColumn("wk", F.when(F.coalesce(fits, F.lit(False)), dates.season_week(F.col("start_date"), F.col("yr"))).otherwise(F.col("wk")))


def clean_names(entities: DataFrame, columns: tuple[str, ...] = ("name", "city")) -> DataFrame:
    """The rows that have a challenger's mark (with or without a number, in any case) at the end of one of ``columns``, without it."""
    marked = F.lit(False)
    for c in columns:
        marked = marked | F.coalesce(F.col(c).rlike(r"(?i)\s+ch(\s+\d+)?$"), F.lit(False))
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+[Cc][Hh](\s+\d+)?$", ""))
    return entities.where(marked).withColumns({c: clean(c) for c in columns})


def change_set(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What a writer would do: insert, update or delete, one row each (a dry run)."""
    from tideline.operators.sets import snapshot_diff

    values = [c for c in before.columns if c not in keys]
    d = snapshot_diff(before, after.select(before.columns), keys, values)
    return d.select(*keys, F.when(F.col("change") == "appeared", "insert").when(F.col("change") == "disappeared", "delete").otherwise("update").alias("op"))


def promote_metadata(exact: DataFrame, generic: DataFrame, columns: list[str]) -> DataFrame:
    """Generic rows take the columns of their mutual best exact row (each exact row serves one generic row); others stay."""
    from tideline.operators.joins import mutual_ladder

    best = mutual_ladder(generic, exact).join(exact.select(F.col("ed_id").alias("xid"), *(F.col(c).alias(f"x_{c}") for c in columns)), "xid")
    out = generic.withColumnRenamed("ed_id", "gid").join(best, "gid", "left")
    return out.select("gid", "xid", *(F.coalesce(f"x_{c}", c).alias(c) for c in columns))
