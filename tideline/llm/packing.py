"""Packing: optimal length buckets from the global histogram, token-budget batches inside each.

The histogram of lengths is one aggregate, with a row for each length that occurs: its size follows the longest text and not
the number of texts. Dynamic programming over it chooses the bucket boundaries with the least padding, exactly; the lower
envelope of the candidates' lines makes a step linear in the number of lengths. Batches are consecutive slots of a bucket, in
the order of a hash of the row; slots are local row numbers in hash-range shards plus the shards' offsets, so no window
holds a whole bucket. ``padded_batches`` puts the token ids of each batch into one padded matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm import byte_bpe
from tideline.llm.common import lower_ascii, words
from tideline.storage import materialise, read_table


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over sorted ``lengths`` that minimise the padded total.

    A bucket (k, j] costs lengths[j] * (rows up to j - rows up to k), so the best k for j is the lowest at x = lengths[j] of
    the lines best[k] - rows[k] * x; x rises and slopes fall, so each layer needs one pass.
    """
    n = len(lengths)
    if n == 0:
        return []
    xs = [int(v) for v in lengths]
    rows = [0, *(int(v) for v in np.cumsum(counts))]
    best = [x * rows[j + 1] for j, x in enumerate(xs)]  # one bucket up to each length
    back: list[list[int]] = []
    for _ in range(min(buckets, n) - 1):
        nxt, at = list(best), [-1] * n
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, k), useful from left to right
        head = 0
        for j in range(1, n):
            m, c = -rows[j], best[j - 1]
            while len(hull) - head >= 2:
                (m1, c1, _), (m2, c2, _) = hull[-2], hull[-1]
                if (c - c1) * (m1 - m2) <= (c2 - c1) * (m1 - m):  # the last line is never lowest
                    hull.pop()
                else:
                    break
            hull.append((m, c, j - 1))
            x = xs[j]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            cost = hull[head][0] * x + hull[head][1] + x * rows[j + 1]
            if cost < nxt[j]:
                nxt[j], at[j] = cost, hull[head][2]
        back.append(at)
        best = nxt
    out, j = [], n - 1
    for at in reversed(back):
        if at[j] >= 0:
            out.append(xs[j])
            j = at[j]
    return sorted({*out, xs[j]})


def _placed(rows: DataFrame, buckets: int, token_budget: int, shard_rows: int) -> DataFrame:
    """``row, bucket, pad_to, batch, slot`` of ``rows`` (row, n_tokens; a written table)."""
    histogram = rows.groupBy("n_tokens").count().orderBy("n_tokens").collect()  # a row for each length: at most the longest text's
    bounds = optimal_bounds(np.array([r["n_tokens"] for r in histogram]), np.array([r["count"] for r in histogram]), buckets) or [0]
    shards = max(1, -(-sum(r["count"] for r in histogram) // shard_rows))
    table = F.array(*(F.lit(b).cast("long") for b in bounds))
    placed = rows.select("row", "n_tokens", F.xxhash64("row").alias("h"), F.size(F.filter(table, lambda b: b < F.col("n_tokens"))).alias("bucket"))
    placed = placed.withColumn("shard", F.pmod(F.shiftrightunsigned("h", 1), F.lit(shards)))
    before = W.partitionBy("bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "shard").count().select("bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(W.partitionBy("bucket", "shard").orderBy("h", "row")) - 1
    slots = placed.withColumn("local", local).join(offsets, ["bucket", "shard"])
    pad = F.get(table, F.col("bucket"))
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(pad, F.lit(1)))).cast("long")
    at = F.col("offset") + F.col("local")
    return slots.select("row", "bucket", pad.alias("pad_to"), F.floor(at / room).cast("long").alias("batch"), (at % room).cast("long").alias("slot"))


def pack(docs: DataFrame, length: Column, id: str = "doc_id", buckets: int = 16, token_budget: int = 65_536, shard_rows: int = 8_192) -> DataFrame:
    """``id, n_tokens, bucket, pad_to, batch, slot``: one row for each row of ``docs``.

    A null length counts as 0. A text longer than the budget is a batch of its own. Rows that repeat an id, and a null id,
    take slots of their own. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"))
    rows = materialise(rows, "pack-lengths")
    return rows.join(_placed(rows, buckets, token_budget, shard_rows), "row").select(F.col("id").alias(id), "n_tokens", "bucket", "pad_to", "batch", "slot")


def padded_batches(docs: DataFrame, tokens: Column, id: str = "doc_id", pad_id: int = 0, buckets: int = 16, token_budget: int = 65_536, shard_rows: int = 8_192) -> DataFrame:
    """``bucket, batch, pad_to, n_docs, n_tokens, n_padding, doc_ids, input_ids``: one row for each batch.

    ``tokens`` gives a row's token ids (``array<int>``; null is empty). ``input_ids`` is the batch's matrix: a row for each document,
    in the order of ``doc_ids``, filled up with ``pad_id`` to ``pad_to``. A batch holds at most ``token_budget`` places or a single
    longer text, so a group is bounded. Rows that repeat an id, and null ids, have rows of their own. An empty table
    gives no batches.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.coalesce(tokens, F.array().cast("array<int>")).alias("tokens"))
    rows = materialise(rows.withColumn("n_tokens", F.size("tokens").cast("long")), "pack-tokens")
    placed = rows.join(_placed(rows.select("row", "n_tokens"), buckets, token_budget, shard_rows), "row")
    held = placed.groupBy("bucket", "pad_to", "batch").agg(F.array_sort(F.collect_list(F.struct("slot", "row", "id", "tokens"))).alias("docs"), F.sum("n_tokens").alias("n_tokens"))
    pad = lambda d: F.concat(d["tokens"], F.array_repeat(F.lit(pad_id), F.col("pad_to").cast("int") - F.size(d["tokens"])))
    n = F.size("docs").cast("long")
    return held.select(
        "bucket", "batch", "pad_to", n.alias("n_docs"), "n_tokens", (n * F.col("pad_to") - F.col("n_tokens")).alias("n_padding"),
        F.transform("docs", lambda d: d["id"]).alias("doc_ids"), F.transform("docs", pad).alias("input_ids"),
    )


def word_count(text: str = "text") -> Column:
    return F.size(words(F.col(text)))


def word_ids(text: str = "text") -> Column:
    """An id from 1 to 2^31 - 2 for each word, by hash: token ids without a vocabulary."""
    return F.transform(words(lower_ascii(F.col(text))), lambda w: (F.pmod(F.xxhash64(w), F.lit((1 << 31) - 2)) + 1).cast("int"))


def token_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, ids``: the ids that a public vocabulary gives the texts, a row for each row of ``docs``."""
    import public_tokenizers

    return byte_bpe.with_ids(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def packed_texts(docs: DataFrame) -> DataFrame:
    """``padded_batches`` of the vocabulary's ids."""
    return padded_batches(token_ids(docs), F.col("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padded batches with a digest of their matrices (row by row, ids joined by commas)."""
    made = padded_batches(read_table(spark, sf_dir, "documents"), word_ids())
    digest = F.sha2(F.array_join(F.transform("input_ids", lambda r: F.array_join(r.cast("array<string>"), ",")), "\n"), 256)
    return made.select("bucket", "batch", "pad_to", "n_docs", "n_tokens", "n_padding", "doc_ids", digest.alias("ids_sha256"))
