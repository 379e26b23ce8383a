"""The corpus pipeline: language ID, quality rules, exact dedup, n-gram Jaccard join, packing.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``. Between stages the rows
are written as Parquet in the shared folder and read again. All stages read whole texts of any length, judge row by row (ids may
repeat or be null), keep extra columns whatever their names, and turn an empty table into an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import exact_dedup, jaccard_join, language_id, packing, quality_rules
from tideline.storage import materialise, read_table

#: Documents whose language is known with less than this calibrated probability are rejected.
MIN_LANGUAGE_SCORE = 0.5


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a row number ``_row``, written once: ids may repeat or be null, so verdicts on copies go by row."""
    return materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")


def _survivor(docs: DataFrame) -> Column:
    """What the survivor of a group has the smallest of: the id (null last), then a hash of the whole row, then the row number."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.xxhash64(*docs.columns).alias("h"), F.col("_row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and texts of no clear language; of two equally likely languages the
    probability is at most a half, and exactly a half stays. Repeated rows share a fate. The classifier's sample comes from the
    stage's input; without rows that have a language every text is rejected."""
    found = language_id.identify(docs, language_id.learn(docs), keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the base rule or the learned decision list rejects; the verdict is an expression over the row itself. Null and
    empty texts fail the base rule; repeated rows share a fate; rows without an id or a label are judged like any other."""
    rules = quality_rules.learn_from_labels(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, rules, keep=tuple(docs.columns)).where("kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the smallest id (a null one last), and of rows that repeat it one. Null text
    equals empty text."""
    rows = _keyed(docs)
    judged = exact_dedup.exact_dedup(rows.select("text", _survivor(docs).alias("_key")), id="_key")
    return rows.join(judged.where("kept").select("_key._row"), "_row", "left_semi").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays (5 words, similarity 0.8): the smallest id (a null one last), and of rows that
    repeat it one. Texts without words have no copies and all stay."""
    rows = _keyed(docs)
    joined = jaccard_join.jaccard_join(rows, jaccard_join.Spec(k=5, num=4, den=5), id="_row").select("_row", "component_id")
    first = rows.select("_row", _survivor(docs).alias("_key")).join(joined, "_row").groupBy("component_id").agg(F.min("_key").alias("_key"))
    return rows.join(first.select("_key._row"), "_row", "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every row by its number of tokens of a public vocabulary (null text: 0): ``doc_id, n_tokens, bucket,
    pad_to, batch, slot``. A text over the budget is a batch of its own; repeated and null ids have slots of their own; an empty
    table gives an empty result; extra columns are ignored, whatever their names."""
    return packing.pack(packing.token_ids(docs), F.size("ids"))


STAGES = [("language_id", language), ("quality_rules", quality), ("exact_dedup", exact), ("jaccard_join", near), ("packing", pack)]

#: Learned stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
