"""Filters, searches, facets and small fan-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import levels, text


def band_label(x: Column, bands: list[tuple[float, str]], last: str) -> Column:
    """The label of the first band whose bound lies above ``x``."""
    out = F.lit(last)
    for bound, label in reversed(bands):
        out = F.when(x < bound, label).otherwise(out)
    return out


def valid_observations(obs: DataFrame) -> DataFrame:
    return obs.where((F.col("cut") >= 3) & levels.tier_group(F.col("level")).isNotNull() & F.col("wk").isNotNull())


def expected_draws(editions: DataFrame) -> DataFrame:
    """``ed_id, ev, dr``: ITF events have singles only, doubles qualifying exists at 500 level."""
    draws = F.array(*(F.struct(F.lit(e).alias("ev"), F.lit(d).alias("dr")) for e, d in (("singles", "main"), ("singles", "qualifying"), ("doubles", "main"), ("doubles", "qualifying"))))
    itf, big = F.col("level").startswith("ITF"), F.col("level") == "ATP 500"
    wanted = F.filter(draws, lambda d: (~itf | (d["ev"] == "singles")) & ((d["ev"] != "doubles") | (d["dr"] == "main") | big))
    return editions.select("ed_id", F.explode(wanted).alias("d")).select("ed_id", "d.ev", "d.dr")


def both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(a, b).union(pairs.select(b, a)).distinct()


def search(df: DataFrame, column: str, q: str, distance: Column, key: str, limit: int = 25) -> DataFrame:
    """Rows whose column contains the pattern literally, nearest first; patterns under 2 characters find nothing."""
    pattern = text.search_pattern(q)
    found = df.where(F.lit(len(pattern) >= 2) & F.contains(F.lower(column), F.lit(pattern.lower())))
    return found.orderBy(distance, key).limit(limit)


def match_all_words(df: DataFrame, haystack: Column, q: str) -> DataFrame:
    hay = text.fold(haystack)
    for word in q.split():
        df = df.where(F.contains(hay, text.fold(F.lit(word))))
    return df


def facet_counts(df: DataFrame, column: str, chosen: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(chosen)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def below_threshold(df: DataFrame, keys: list[str], ranks: list[str], n: int) -> DataFrame:
    """Unpivot the rank columns and keep what lies under ``n``, with its source column."""
    return df.unpivot(keys, ranks, "src", "rnk").where(F.col("rnk") < n)


def canonical_countries(df: DataFrame, country: str, aliases: DataFrame, continents: DataFrame) -> DataFrame:
    """``df`` with ``shown`` (the alias's short name, else the country as it is) and ``continent`` by the spelling as given, then by the
    short name. ``aliases`` has alias and name, ``continents`` country and continent, all lower-case keys; both are parameters,
    joined by adaptive execution."""
    key = lambda c: F.lower(F.trim(c))
    shown = df.withColumn("_k", key(F.col(country))).join(aliases.select(F.col("alias").alias("_k"), "name"), "_k", "left").withColumn("shown", F.coalesce("name", country)).drop("name")
    first = shown.join(continents.select(F.col("country").alias("_k"), F.col("continent").alias("_c1")), "_k", "left").withColumn("_s", key(F.col("shown")))
    both = first.join(continents.select(F.col("country").alias("_s"), F.col("continent").alias("_c2")), "_s", "left")
    return both.select(*df.columns, "shown", F.coalesce("_c1", "_c2").alias("continent"))


#: Entry code, label, whether its number is of another ranking, the levels it may be used at (empty: any).
ENTRY_CODES = [
    ("NG", "Next Gen Accelerator", False, "CH 50,CH 75,CH 100,CH 125"), ("JR", "Junior Accelerator — number is an ITF junior ranking", True, "CH 50,CH 75"), ("CO", "College Accelerator — number is an ITA collegiate ranking", True, "CH 50,CH 75"),
    ("WC", "Wild card", False, ""), ("SE", "Special exempt", False, ""), ("PR", "Protected ranking", False, ""), ("Q", "Qualifier", False, ""), ("ALT", "Alternate", False, ""),
]


def entry_codes(df: DataFrame, code: str, level: str, rank: str) -> DataFrame:
    """``df`` with ``label``, ``foreign`` (the number is of another ranking), ``allowed`` (the code may be used at the level) and ``shown`` (what
    stands in the ranking column). Unknown codes have no label and are allowed."""
    table = df.sparkSession.createDataFrame(ENTRY_CODES, "_code string, label string, _foreign boolean, _levels string")
    got = df.withColumn("_code", F.upper(F.trim(code))).join(F.broadcast(table), "_code", "left")  # eight rows
    known = F.when(F.col("label").isNotNull(), F.col("_code"))
    foreign = F.coalesce("_foreign", F.lit(False))
    allowed = F.coalesce((F.col("_levels") == "") | F.array_contains(F.split("_levels", ","), F.trim(level)), F.lit(True))
    shown = F.when(foreign, known).when(F.col(rank).isNull(), F.coalesce(known, F.lit(""))).otherwise(F.concat_ws(" ", F.col(rank).cast("string"), known))
    return got.select(*df.columns, "label", foreign.alias("foreign"), allowed.alias("allowed"), shown.alias("shown"))
