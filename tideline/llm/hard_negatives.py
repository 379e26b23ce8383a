"""Hard-negative mining: exact threshold joins over a pruned inverted index, with thresholds that go down until windows fill.

A window asks for the rows of an anchor whose score is at most ``high``, at least ``low``, best first, until it has ``want`` of them. All
windows begin with a high threshold; a round finds every row between an anchor's threshold and the one before; windows that
are full, or whose threshold has reached their low end, are done, and the others go on with a lower threshold. The last one is
minus infinity, so a window that can't be filled ends by having seen everything.

A round is a join of blocks of rows with blocks of anchors, each pair of blocks in a task of its own. A task indexes its rows: dimensions
come in the order of their weight, the dimensions from which on a row's remaining norm can't reach the threshold have no postings
(the bound on suffix norms), and postings of some dimensions in a row are a slice of the rows, which are sorted by how many of
their dimensions are indexed. Scores are accumulated over the postings; after each step pairs whose partial score and remaining norms
stay below the threshold are pruned, and what is left takes the dimensions that were not indexed. A task returns at most
``want`` rows for each window.

Scores are sums of products of integers: doubles hold them exactly below 2**53, and a block that might go beyond is summed up in
Python's integers (a score must fit 64 bits). Each comparison with a bound of norms leaves room for rounding.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.spread import spread_join
from tideline.storage import materialise, read_table

#: Rows and anchors of a block: a task's scores are a matrix of doubles, 64 MB.
ROW_BLOCK, ANCHOR_BLOCK = 4096, 2048
#: Dimensions whose postings are accumulated before pairs are pruned.
STEP = 8
#: Thresholds of the positives by shares of the largest possible score, before minus infinity.
SHARES = (0.7, 0.35, 0.15)
LOWEST = float("-inf")

FOUND = "anchor long, win long, other long, score long"


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles, padded by zeros."""
    lists = column.combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    first = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(first[-1]) - first[row]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _norms_from(x: np.ndarray) -> np.ndarray:
    """The norm of each row's dimensions from d on, for d from 0 to their number."""
    tail = np.sqrt(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1])
    return np.concatenate([tail, np.zeros((len(x), 1))], axis=1)


def _reaches(bound: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether an upper bound may reach the threshold, with room for rounding."""
    return bound + 1e-9 * np.abs(bound) + 1e-3 >= least


class Index:
    """Rows of a block by dimension, for queries of norm ``reach`` at most and thresholds of ``least`` at least."""

    def __init__(self, rows: np.ndarray, reach: float, least: float):
        self.dims = np.argsort(-(rows * rows).sum(axis=0), kind="stable")  # the heaviest dimension first
        rows = rows[:, self.dims]
        left = _norms_from(rows)
        # A row has postings up to the last dimension from which on its rest could still reach the threshold by itself.
        posted = _reaches(left[:, :-1] * reach, np.array(least)).sum(axis=1)
        posted = np.minimum(-(-posted // STEP) * STEP, rows.shape[1])
        self.by = np.argsort(-posted, kind="stable")
        self.rows, self.left, self.posted = rows[self.by], left[self.by], posted[self.by]

    def search(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, row, score)`` of all pairs whose score is at least the query's ``least``."""
        q = queries[:, self.dims]
        q_left, width = _norms_from(q), q.shape[1]
        n = int(np.searchsorted(-self.posted, 0)) if width else len(self.rows)  # a row without postings can't reach any threshold
        score, ok = np.zeros((len(q), n)), np.ones((len(q), n), dtype=bool)
        high = 0
        while high < width and (holds := int(np.searchsorted(-self.posted[:n], -high))):
            low, high = high, min(high + STEP, width)
            score[:, :holds] += q[:, low:high] @ self.rows[:holds, low:high].T  # the postings of these dimensions
            ok[:, :holds] &= _reaches(score[:, :holds] + q_left[:, high, None] * self.left[None, :holds, high], least[:, None])
            if ok.mean() < 0.02:
                break
        i, j = np.nonzero(ok)
        got, done = score[i, j], np.minimum(self.posted[j], high)
        del score, ok
        for low in range(0, width, STEP):  # candidates take the dimensions that are missing
            high = min(low + STEP, width)
            need = done <= low
            if need.any():
                got[need] += np.einsum("ij,ij->i", q[i[need], low:high], self.rows[j[need], low:high])
                done[need] = high
                fit = _reaches(got + q_left[i, done] * self.left[j, done], least[i])
                i, j, got, done = i[fit], j[fit], got[fit], done[fit]
        if width and float(np.abs(q).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) * width >= 2**53:
            got = np.array([sum(int(a) * int(b) for a, b in zip(q[x], self.rows[y], strict=True)) for x, y in zip(i, j, strict=True)], dtype=object)
        keep = (got >= least[i]).astype(bool)
        return i[keep], self.by[j[keep]], got[keep]


def _best(anchor: np.ndarray, win: np.ndarray, other: np.ndarray, score: np.ndarray, want: int) -> np.ndarray:
    """The places of the first ``want`` rows of each (anchor, window): higher scores first, then smaller ids."""
    order = np.lexsort((other, -score, win, anchor))
    a, w = anchor[order], win[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])])[: len(a)]
    start = np.flatnonzero(new)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return order[rank < want]


def _searcher(want: int, same: bool):
    """A task's search: the first ``want`` rows of its block for each window of its anchors."""

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        kinds = [("anchor", pa.int64()), ("win", pa.int64()), ("other", pa.int64()), ("score", pa.int64())]
        if not rows.num_rows or not anchors.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds})
        sizes = [pc.max(pc.list_value_length(t.column("vec"))).as_py() or 0 for t in (rows, anchors)]
        x, q = _matrix(rows.column("vec"), max(sizes)), _matrix(anchors.column("vec"), max(sizes))
        least = anchors.column("least").to_numpy()
        index = Index(x, float(np.sqrt((q * q).sum(axis=1)).max()), float(least.min()))
        i, j, score = index.search(q, least)
        row_id, row_label = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        id_, label = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
        fit = (row_label[j] == label[i]) == same
        fit &= row_id[j] != id_[i]
        i, j, score = i[fit], j[fit], score[fit]
        wins = anchors.column("wins").combine_chunks()
        n = pc.list_value_length(wins).to_numpy(zero_copy_only=False).astype(np.int64)
        first, flat = np.concatenate([[0], np.cumsum(n)]), wins.flatten()
        w_id, w_low, w_high = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("win", "low", "high"))
        pair = np.repeat(np.arange(len(i)), n[i])
        w = first[i][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n[i]) - n[i], n[i])
        fit = ((score[pair] >= w_low[w]) & (score[pair] <= w_high[w])).astype(bool)
        pair, w = pair[fit], w[fit]
        anchor, other, score = id_[i][pair], row_id[j][pair], score[pair].astype(np.int64)
        top = _best(anchor, w_id[w], other, score, want)
        return pa.table([pa.array(c, t) for c, (_, t) in zip((anchor[top], w_id[w][top], other[top], score[top]), kinds, strict=True)], names=[k for k, _ in kinds])

    return search


def _dealt(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows by part, row block and anchor block, written; anchors with the numbers of their part's blocks. A part is dealt to as many
    blocks as its size needs, so no task holds a part; parts without anchors go."""
    n = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(anchors.groupBy("part").agg(F.count(F.lit(1)).alias("m")), "part")
    blocks = materialise(n.select("part", F.ceil(F.col("n") / ROW_BLOCK).cast("int").alias("n"), F.ceil(F.col("m") / ANCHOR_BLOCK).cast("int").alias("m")), "blocks")
    left = spread_join(rows, blocks, ["part"], F.col("id")).select("part", "id", "label", "vec", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("ab"))
    right = spread_join(anchors, blocks, ["part"], F.col("id"), counted=rows).withColumn("ab", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    return materialise(left, "row-blocks"), right


def threshold_join(rows: DataFrame, anchors: DataFrame, want: int, same: bool) -> DataFrame:
    """``anchor, win, other, score, rank``: for each window of the anchors the first ``want`` rows of the same label (or of other labels)
    among those that score the anchor's ``least`` or more and lie in the window.

    ``rows`` are dealt ones; ``anchors`` too, with least and wins, an array of (win, low, high).
    """
    keys = ["part", "rb", "ab"]
    copies = anchors.withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(*keys, "id", "label", "vec", "least", "wins")
    found = rows.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(_searcher(want, same), FOUND)
    order = W.partitionBy("anchor", "win").orderBy(F.col("score").desc(), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want)


def _fill(rows: DataFrame, anchors: DataFrame, thresholds: list[Column], want: int, same: bool) -> DataFrame:
    """``anchor, win, other, score, rank``: rounds of the threshold join until every window is full or its low end is not below the threshold.

    ``thresholds`` are expressions over an anchor's row, each below the one before; the last must be at or below the low end of all windows.
    """
    blocks, todo = _dealt(rows, anchors)
    parts = []
    for k, least in enumerate(thresholds):
        asked = materialise(todo.withColumn("least", least.cast("double")), "windows")
        found = materialise(threshold_join(blocks, asked, want, same), "found")
        if k + 1 == len(thresholds):
            parts.append(found)
            break
        full = found.groupBy(F.col("anchor").alias("id"), "win").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= want).select("id", "win", F.lit(True).alias("_full"))
        each = asked.select("id", "least", F.explode("wins").alias("w")).select("id", "least", "w.*").join(full, ["id", "win"], "left")
        open_ = F.col("_full").isNull() & (F.col("least") > F.col("low"))
        parts.append(found.join(each.where(~open_).select(F.col("id").alias("anchor"), "win"), ["anchor", "win"], "left_semi"))
        left = materialise(each.where(open_).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("win", "low", "high"))).alias("wins")), "open-windows")
        if left.isEmpty():
            break
        todo = asked.drop("wins", "least").join(left, "id")
    return reduce(DataFrame.unionByName, parts)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its best ``positives`` rows of
    the same label, the best ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    ``vectors`` has id, label (long) and vec (array<double> of integers); ``is_anchor`` is an expression over these. Rows with a null id, label or
    vector, or with a null or non-finite component, take no part. Of rows that share an id the one with the smallest label and vector
    counts. Shorter vectors end in zeros. Ties go to the smaller id. Windows of negative scores are empty. An empty table, or one
    without anchors, gives an empty result. Other columns are ignored.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.select("id", "label", "vec").where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    one = valid.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    rows = materialise(one.withColumn("norm", norm), "vectors")
    longest = rows.agg(F.max("norm")).first()[0] or 0.0
    every = [F.struct(F.lit(0).cast("long").alias("win"), F.lit(-(1 << 63)).alias("low"), F.lit((1 << 63) - 1).alias("high"))]
    anchors = rows.where(is_anchor).withColumn("wins", F.array(*every)).withColumn("part", F.col("label"))
    shares = [F.col("norm") * longest * s for s in SHARES] + [F.lit(LOWEST)]
    best = materialise(_fill(rows.withColumn("part", F.col("label")), anchors, shares, positives, True), "positives")

    score = F.col("score")
    bounds = F.struct(F.col("other").alias("win"), F.expr(f"(cast(score as decimal(20, 0)) * {low} + 99) div 100").alias("low"), F.expr(f"(cast(score as decimal(20, 0)) * {high}) div 100").alias("high"))
    asked = best.where(score >= 0).select(F.col("anchor").alias("id"), bounds.alias("w")).groupBy("id").agg(F.array_sort(F.collect_list("w")).alias("wins"), F.min("w.low").alias("_low"), F.min("w.high").alias("_high"))
    targets = rows.where(is_anchor).join(asked, "id").withColumn("part", F.lit(0).cast("long"))
    steps = [F.col("_low") + (F.col("_high") - F.col("_low")) * share for share in (0.6,)] + [F.col("_low")]
    got = _fill(rows.withColumn("part", F.lit(0).cast("long")), targets, steps, negatives, False)
    known = best.select("anchor", F.col("other").alias("win"), score.alias("positive_score"))
    out = got.join(known, ["anchor", "win"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("win").alias("positive_id"), "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    vec = F.transform("embedding", lambda x: F.rint(F.floor(x.cast("double") * 256).cast("double")))
    return mine(e.select(F.col("vec_id").alias("id"), label.alias("label"), vec.alias("vec")), F.col("id") % 100 == 0)


ORACLE_SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.vec, b.vec)::BIGINT AS score FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT a, b AS pos, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, pos, ps, b, score, row_number() OVER (PARTITION BY p.a, pos ORDER BY score DESC, b) AS rank FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * ps <= 100 * score AND 100 * score <= 100 * ps)
SELECT a AS anchor_id, pos AS positive_id, cast(rank AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE rank <= 5
"""
