"""Joins of a large table with one row for each key when few keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with more than this share of the rows is hot, so at most 1 / HOT_SHARE keys are: the bound of the broadcast.
HOT_SHARE = 0.001
#: Fewer rows than this are no burden for one task.
HOT_ROWS = 200


def hot_keys(rows: DataFrame, on: list[str], share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame | None:
    """``on, _n`` of the keys with more than ``share`` of the rows (at most 1 / share of them); None if there are none."""
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    line = max(share * (total or 0), least)
    if (most or 0) <= line:
        return None
    hot = counts.where(F.col("_n") > line).collect()  # at most 1 / share rows
    kinds = rows.select(*on).schema.fields
    salts = lambda n: F.lit(-(-n // max(1, int(line)))).cast("int").alias("_salts")
    table = F.array(*(F.struct(*(_literal(r[f.name], f.dataType).alias(f.name) for f in kinds), salts(r["_n"])) for r in hot))
    return rows.sparkSession.range(1).select(F.explode(table).alias("x")).select("x.*")


def _literal(value, kind: T.DataType) -> Column:
    if value is not None and isinstance(kind, T.StructType):
        return F.struct(*(_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
    return F.lit(bytes(value) if isinstance(value, bytearray) else value).cast(kind)


def spread_join(many: DataFrame, one: DataFrame, on: list[str], by: Column, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``many`` joined with ``one`` (at most one row for each key) on the columns ``on``.

    Rows of hot keys are dealt by the key and a salt from ``by``; the row of ``one`` is copied to each salt. Hot keys are
    counted in ``counted`` (a table with ``on``; ``many`` itself by default), which is read in a job of its own
    and should be a written table. ``how`` is inner, left or left_semi.
    """
    return salted_join(many, one, on, by, hot_keys(many if counted is None else counted, on), how)


def salted_join(many: DataFrame, one: DataFrame, on: list[str], by: Column, hot: DataFrame | None, how: str = "inner", hint: str | None = None) -> DataFrame:
    """``spread_join`` with the hot keys given: ``hot_keys`` of a table on all or some of the columns ``on``. With ``hint`` (merge,
    shuffle_hash) the strategy is the same at every size."""
    hinted = lambda df: df.hint(hint) if hint else df
    if hot is None:
        return many.join(hinted(one), on, how)
    small, keys = F.broadcast(hot), [c for c in on if c in hot.columns]  # at most 1 / HOT_SHARE rows
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_salts"))).cast("int")
    left = many.join(small, keys, "left").withColumn("_salt", salt).drop("_salts")
    right = one.join(small, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(hinted(right), [*on, "_salt"], how).drop("_salt")
