"""Sources: quoted CSV, JSON with tolerant keys, labelled text, movement notes, codes in URLs, line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators import windows


def load_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Columns by header name, quoted commas kept; a missing column is an error, rows whose typed cells don't parse are dropped."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)
    lost = [c for c in columns if c not in raw.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    out = raw.select(*(F.expr(f"try_cast(`{c}` as {kind})").alias(c) if kind != "compact_date" else F.expr(f"cast(try_to_timestamp(`{c}`, 'yyyyMMdd') as date)").alias(c) for c, kind in columns.items()))
    return out.where(" and ".join(f"`{c}` is not null" for c, kind in columns.items() if kind != "string") or "true")


def flatten_json(df: DataFrame, payload: str, fields: dict[str, list[str]], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records of a JSON payload (a bare array, or one under items, results or data, or one object): the first non-null of
    each field's candidate keys. Returns valid rows and rejects with the reason."""
    v = F.try_parse_json(payload)
    body = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("items", "results", "data")), F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)))
    rows = df.withColumn("_r", F.explode_outer(body))
    flat = rows.select(*df.columns, *(F.coalesce(*(F.try_variant_get("_r", f"$.{k}", "string") for k in keys)).alias(f) for f, keys in fields.items()))
    reason = F.coalesce(F.when(F.coalesce(*(F.col(f) for f in fields)).isNull(), F.lit("no record")), *(F.when(F.col(f).isNull(), F.lit(f"no {f}")) for f in required))
    tagged = flat.withColumn("reason", reason)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def extract_records(df: DataFrame, id: str, body: str, record: str, names: list[str]) -> DataFrame:
    """One row for each line that matches ``record``, with its groups as columns."""
    lines = df.select(id, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\n")).alias("line_no", "line")).where(F.col("line").rlike(record))
    return lines.select(id, "line_no", *(F.regexp_extract("line", record, k).alias(n) for k, n in enumerate(names, 1)))


def labelled_value(body: Column, label: str) -> Column:
    """What follows 'LABEL:' up to the end of the line; null if absent."""
    return F.nullif(F.trim(F.regexp_extract(body, rf"(?m)^{label}:[ \t]*(.+)$", 1)), F.lit(""))


def parse_movements(df: DataFrame, id: str, note: str) -> DataFrame:
    """'OUT: A, B IN: C Next: D' to rows of kind and player."""
    kinds = {"OUT": "withdrawal", "IN": "promotion", "Next": "reported-next"}
    names = F.array().cast("array<struct<kind: string, player: string>>")
    for label, kind in kinds.items():
        part = F.regexp_extract(note, rf"{label}:[ ]*(.*?)[ ]*(?=OUT:|IN:|Next:|$)", 1)
        names = F.concat(names, _tagged(F.filter(F.split(part, r"[ ]*,[ ]*"), lambda x: x != ""), kind))
    return df.select(id, F.explode(names).alias("m")).select(id, "m.kind", "m.player")


def _tagged(names: Column, kind: str) -> Column:
    return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("player")))


def extract_code(columns: list[str], patterns: list[str]) -> Column:
    """The first group of the first pattern that matches, over the columns in order."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns for c in columns))


def latest_code(df: DataFrame, key: str, code: str, newest: str) -> DataFrame:
    return df.where(F.col(code).isNotNull()).groupBy(key).agg(F.max_by(code, newest).alias(code))


def fill_down(lines: DataFrame, doc: str, section: Column, carried: Column, skip: Column) -> DataFrame:
    """Context of a line table: a section line resets, a carried value holds until replaced; skipped lines have a reason. Sections are
    numbered and values carried by ranges of lines, so one long document is the work of several tasks."""
    tagged = lines.withColumn("_head", F.coalesce(section, F.lit(False)).cast("long")).withColumn("_v", carried)
    numbered = windows.prefix_sum(tagged, [doc], ["line_no"], "_head", "section_no")
    return windows.carry_forward(numbered, [doc, "section_no"], ["line_no"], "_v", "context").withColumn("skipped", skip).drop("_head", "_v")


def unique_lines(lines: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """Lines that are not skipped, once for each of ``keys`` (season, name key, date): the first of a document stays. Null keys are equal."""
    first = lines.where("skipped is null").withColumn("_row", F.struct(*lines.columns))
    return first.groupBy(doc, *keys).agg(F.min_by("_row", "line_no").alias("_row")).select("_row.*")


def validate_rows(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejects with the first failing rule."""
    tagged = df.withColumn("reason", F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules)))
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def load_rankings(spark: SparkSession, ranks: str, players: str) -> tuple[DataFrame, DataFrame]:
    """Ranking snapshots (date, rank, player) and the players' name keys."""
    r = load_csv(spark, ranks, {"date": "compact_date", "rank": "int", "player": "bigint"})
    p = load_csv(spark, players, {"player": "bigint", "name": "string"}).withColumn("name_key", text.sorted_name_key(F.col("name")))
    return r, p


def write_scope(df: DataFrame, path: str, scope: list[str]) -> None:
    """Replace only the partitions (scopes) that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def load_registry(spark, paths: list[str], schema: str, keys: list[str]):
    """A static registry (catalogue, aliases, overrides, cancelled rules) from CSV files as a dimension: quoted fields, trimmed, blank is null, one
    row for each key (the last file and line win). Whether it is broadcast is left to its measured size."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    parts = None
    for place, path in enumerate(paths):
        raw = spark.read.csv(path, header=True, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="")
        one = raw.select("*", F.lit(place).alias("_p"), F.col("_metadata.file_name").alias("_f"), F.monotonically_increasing_id().alias("_n"))
        parts = one if parts is None else parts.unionByName(one)
    last = W.partitionBy(*keys).orderBy(F.col("_p").desc(), F.col("_f").desc(), F.col("_n").desc())
    return parts.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "_p", "_f", "_n").where(F.coalesce(*keys).isNotNull())
