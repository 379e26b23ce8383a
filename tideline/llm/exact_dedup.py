"""Exact dedup: a log-structured merge index of text digests, with byte verification of every hit.

Each task's rows fill memtables of a bounded number of rows; a full one flushes a *run*: one row for a digest in it, sorted,
with a blocked Bloom filter (``filters``). Compaction merges ``fan_in`` runs into one of the next level, which is
written, until one run is left; the smallest identifier of a digest wins. Before a merge every digest is probed in the filters
of the other runs of its group: a digest that no other run can have goes up as it is, the rest is merged. A
digest that holds more than one row is a *hit*; its rows' normalised texts are compared byte for byte (the smallest and
the largest text of the group must be the same bytes), and a digest that fails is split by the text itself. Aggregates
combine on the map side and joins salt hot digests, so a digest that holds a third of all rows meets no single task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import WS
from tideline.operators.spread import hot_keys, salted_join
from tideline.storage import materialise, read_table

#: A filter's block has four words of 64 bits, in each of which a digest sets one bit; about as many digests share a block.
WORDS, BLOCK = 4, 16


def normalise(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")


def flush_runs(entries: DataFrame, memtable_rows: int) -> tuple[DataFrame, int]:
    """``run, digest, keep, rows`` sorted inside each run, and the number of runs. A memtable holds the next ``memtable_rows`` rows
    of a task (``pos`` is the task's number and the row's)."""
    task, row = F.shiftright("pos", 33), F.col("pos").bitwiseAND((1 << 33) - 1)
    tasks, rows = entries.agg(F.max(task), F.max(row)).first()
    if tasks is None:
        return entries.select(F.lit(0).cast("long").alias("run"), "digest", F.col("id").alias("keep"), F.lit(1).cast("long").alias("rows")), 0
    slices = rows // memtable_rows + 1
    run = (task * slices + F.floor(row / memtable_rows)).cast("long")
    got = entries.groupBy(run.alias("run"), "digest").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("rows"))
    return materialise(got.sortWithinPartitions("run", "digest"), "lsm-runs"), (tasks + 1) * slices


def _bits() -> list[Column]:
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("digest", F.lit(k)), F.lit(64)).cast("int")) for k in range(WORDS)]


def filters(level: DataFrame, blocks: int) -> DataFrame:
    """``run, block, w0..``: the Bloom filter of each run, a row for each block in use."""
    block = F.pmod(F.xxhash64("digest", F.lit("block")), F.lit(blocks)).alias("block")
    return level.groupBy("run", block).agg(*(F.bit_or(b).alias(f"w{k}") for k, b in enumerate(_bits())))


def merge_level(level: DataFrame, fan_in: int, blocks: int) -> DataFrame:
    """The runs of the next level, ``fan_in`` runs in each; digests that no other run of the group can have are not merged."""
    group = F.floor(F.col("run") / fan_in).cast("long")
    others = filters(level, blocks).groupBy(group.alias("group"), "block").agg(F.collect_list(F.struct("run", *(f"w{k}" for k in range(WORDS)))).alias("others"))  # at most fan_in
    block = F.pmod(F.xxhash64("digest", F.lit("block")), F.lit(blocks))
    own = level.select(group.alias("group"), "run", "digest", "keep", "rows", block.alias("block"), *(b.alias(f"b{k}") for k, b in enumerate(_bits())))

    def has(f: Column) -> Column:
        out = f["run"] != F.col("run")
        for k in range(WORDS):
            out = out & (f[f"w{k}"].bitwiseAND(F.col(f"b{k}")) != 0)
        return out

    probed = own.join(others, ["group", "block"]).select("group", "digest", "keep", "rows", F.exists("others", has).alias("maybe"))
    probed = materialise(probed, "lsm-probed")
    alone = probed.where("not maybe").select(F.col("group").alias("run"), "digest", "keep", "rows")
    merged = probed.where("maybe").groupBy(F.col("group").alias("run"), "digest").agg(F.min("keep").alias("keep"), F.sum("rows").alias("rows"))
    return materialise(alone.unionByName(merged).sortWithinPartitions("run", "digest"), "lsm-runs")


def compact(runs: DataFrame, count: int, memtable_rows: int, fan_in: int) -> DataFrame:
    """``digest, keep, rows`` of the one run that is left when every level has been merged into the next."""
    rows = memtable_rows
    while count > 1:
        runs = merge_level(runs, fan_in, max(1, rows // BLOCK))
        count, rows = -(-count // fan_in), rows * fan_in
    return runs.select("digest", "keep", "rows")


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    digest: Callable[[Column], Column] = F.xxhash64,
    memtable_rows: int = 65_536,
    fan_in: int = 16,
) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256``, one row for each row of ``docs``.

    Equal means equal after ``normalise``. The row with the smallest id stays; rows that repeat that id too are all
    marked kept. A null id sorts after every other id, so it is kept only where its whole group has none; null text
    equals empty text. An empty table gives an empty result. Other columns of ``docs`` are ignored, whatever their names.
    """
    norm = docs.select(F.col(id).alias("id"), normalise(F.col(text)).alias("norm"))
    entries = norm.select("id", digest(F.col("norm")).alias("digest"), F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("pos"))
    entries = materialise(entries, "lsm-entries")
    index = compact(*flush_runs(entries, memtable_rows), memtable_rows, fan_in)
    hot = hot_keys(entries, ["digest"])

    hits = index.where("rows > 1").select("digest")
    texts = salted_join(norm.withColumn("digest", digest(F.col("norm"))), hits, ["digest"], F.col("id"), hot, "left_semi", "merge")  # hits grow with the table: no broadcast at any size
    groups = texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    wrong = materialise(groups.where("a <> b").select("digest"), "lsm-wrong")

    by_digest = index.join(wrong, "digest", "left_anti").select("digest", F.lit("").alias("part"), "keep", "rows")
    split = salted_join(entries, wrong, ["digest"], F.col("pos"), hot, "left_semi").groupBy("digest", F.col("sha").alias("part")).agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("rows"))
    tagged = salted_join(entries, wrong.withColumn("bad", F.lit(True)), ["digest"], F.col("pos"), hot, "left").withColumn("part", F.when(F.col("bad"), F.col("sha")).otherwise(F.lit("")))
    return salted_join(tagged, by_digest.unionByName(split), ["digest", "part"], F.col("pos"), hot).select(
        F.col("id").alias(id),
        F.col("keep").alias("keep_id"),
        F.col("rows").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""
