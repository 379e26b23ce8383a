"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

Documents come in batches of ascending identifiers, by size. Each batch merge-anti-joins its line hashes with the runs of the
earlier ones: hashes found there belong to an earlier document, the rest form a new run, sorted by hash, with the
smallest document that holds each. When a level has ``fan_in`` runs they are compacted into one run of the next level.
A line whose hash has an owner with a smaller identifier is dropped.

A line is known by two independent 64-bit hashes of its key, which must both agree (a chance below 1e-20 of one wrong
drop among a billion different lines). Hashes are combined on the map side, and the join of lines with owners salts
hot lines, so that a line a third of all documents share meets no single task. What a document loses is a list of line
numbers, so that its time grows with its lines and not with their square.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import WS, let, lower_ascii
from tideline.operators.spread import spread_join
from tideline.storage import materialise, read_table

#: Stands for a null identifier: after every other.
LAST = (1 << 63) - 1
HASH = ["h", "g"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.regexp_replace(line, f"^[{WS}]+|[{WS}]+$", ""))


def _line_hashes(text: Column, min_chars: int) -> Column:
    """``pos, h, g`` of each line whose key has ``min_chars`` code points or more; shorter ones are never dropped."""
    keys = F.transform(F.split(text, "\n"), lambda line, pos: F.struct(pos.alias("pos"), line_key(line).alias("key")))
    long = F.filter(keys, lambda x: F.length(x["key"]) >= min_chars)
    return F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h"), F.xxhash64(F.lit(1), x["key"]).alias("g")))


def _merge(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs).groupBy(*HASH).agg(F.min("owner").alias("owner"))


def _flush(run: DataFrame) -> DataFrame:
    return materialise(run.sortWithinPartitions(*HASH), "line-run")


def owners(lines: DataFrame, batches: int, fan_in: int) -> DataFrame:
    """``h, g, owner``: the smallest document of every line hash, by levelled runs over the batches."""
    levels: list[list[DataFrame]] = [[]]
    for batch in range(batches):
        fresh = lines.where(F.col("batch") == batch).groupBy(*HASH).agg(F.min("id").alias("owner"))
        for run in (r for level in levels for r in level):
            fresh = fresh.join(run.select(*HASH), HASH, "left_anti")
        levels[0].append(_flush(fresh))
        for k in range(len(levels)):  # a full level is compacted into one run of the next
            if len(levels[k]) >= fan_in:
                if k + 1 == len(levels):
                    levels.append([])
                levels[k + 1].append(_flush(_merge(levels[k])))
                levels[k] = []
    return reduce(DataFrame.unionByName, [r for level in levels for r in level])  # runs are disjoint


def line_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", min_chars: int = 10, batch_bytes: int = 256 << 20, max_batches: int = 64, fan_in: int = 3) -> DataFrame:
    """``id, n_lines, n_dropped, kept_text``, one row for each row of ``docs``.

    Null or empty text is one empty line. Rows that repeat an id are one document for ownership, and each is returned. A
    null id comes after all others, so its lines stay only where no other document has them. An empty table gives
    an empty result; other columns are ignored. Batches hold ``batch_bytes`` of text, or more where the table has more than
    ``max_batches`` of them; the result does not depend on the batches.
    """
    src = docs.select(F.col(id).alias("raw_id"), F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = min(max_batches, max(1, -(-size // batch_bytes)))
    cuts = [int(x) for x in src.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01)] if batches > 1 else []
    batch = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("id"))) if cuts else F.lit(0)
    doc = src.withColumn("doc", F.md5("text"))  # rows that share an id are told apart by their text
    lines = doc.select("id", "doc", F.explode(_line_hashes(F.col("text"), min_chars)).alias("x"), batch.alias("batch")).select("id", "doc", "x.pos", "x.h", "x.g", "batch")
    lines = materialise(lines, "line-hashes", lambda w: w.partitionBy("batch"))

    late = spread_join(lines, owners(lines, batches, fan_in), HASH, F.struct("id", "doc")).where("owner < id")
    drops = late.groupBy("id", "doc").agg(F.collect_set("pos").alias("gone"))
    joined = spread_join(doc, drops, ["id", "doc"], F.monotonically_increasing_id(), "left")
    rest = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone"))
    kept = let(F.split("text", "\n"), lambda x: F.when(F.col("gone").isNull(), x).otherwise(F.transform(rest(x), lambda k: F.get(x, k))))
    n = F.size(F.split("text", "\n")).cast("long")
    return joined.select(F.col("raw_id").alias(id), n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
