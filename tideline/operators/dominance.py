"""Sums over all points that lie below a point in two orders, without pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.windows import prefix_sum


def dominance_sum(points: DataFrame, asked: DataFrame, by: list[str], x: str, y: str, value: str, out: str) -> DataFrame:
    """``asked`` with ``out``: the sum of ``value`` of the points of the same ``by`` whose x and y are both smaller (0 if there are none).

    ``x`` is any order, ``y`` a number from 0; ``asked`` has ``by``, x, y and a unique ``id``. Two different values of y part at exactly one bit: at
    each bit that a row of ``asked`` has, the points without it that agree in the higher bits are added up along x. So a row
    takes part once for each bit, and running sums go by ranges (``prefix_sum``), whatever the size of a group.
    """
    top = points.select(F.max(y).alias("y")).unionAll(asked.select(F.max(y))).agg(F.length(F.bin(F.max("y")))).first()[0] or 1
    rows = points.select(*by, F.col(x).alias("_x"), F.col(y).cast("long").alias("_y"), F.col(value).alias("_v"), F.lit(None).cast("long").alias("_id"))
    rows = rows.unionByName(asked.select(*by, F.col(x).alias("_x"), F.col(y).cast("long").alias("_y"), F.lit(None).cast(rows.schema["_v"].dataType).alias("_v"), F.col("id").cast("long").alias("_id")))
    level = rows.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(top - 1))))
    one = F.expr("shiftright(_y, _bit) % 2") == 1
    level = level.where(F.when(F.col("_id").isNull(), ~one).otherwise(one)).withColumn("_head", F.expr("shiftright(_y, _bit + 1)"))
    # Rows of ``asked`` come before points of the same x, which are not smaller.
    tagged = level.withColumn("_late", F.col("_id").isNull()).withColumn("_w", F.coalesce("_v", F.lit(0)))
    run = prefix_sum(tagged, [*by, "_bit", "_head"], ["_x", "_late", "_y", "_id"], "_w", "_sum")
    sums = run.where("_id is not null").groupBy(F.col("_id").alias("id")).agg(F.sum("_sum").alias(out))
    return asked.join(sums, "id", "left").withColumn(out, F.coalesce(out, F.lit(0)))
