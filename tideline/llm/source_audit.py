"""Source divergence audit: how far the term distributions of the sources of a language lie apart.

The kept terms of a language are the rows of a one-hot matrix, whose columns are the pairs (source, count level): a term has a one in a
source's column of the count that it has there. The product of the matrix' transpose with itself holds the joint table of every
two sources: how many terms have count c in one and d in the other. The price of a term depends on nothing else, so the tables are
priced and not the terms. Level 0 has no columns: with inclusion and exclusion, what a table says of it follows from the sources'
own level counts. The product is made in exact blocks: rows are cut where a block would need too many columns, columns are cut into
tiles, and the nonzero cells are summed up by Spark.

Every sum and quotient is one of integers. A term's counts leave a task added up, so a term that is in every text reaches the shuffle
once for each flush and source.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.terms import byte_table, term_lists
from tideline.storage import materialise, read_table

#: Entries that a task holds before it hands its counts on.
HELD = 400_000
#: Rows of a block, and columns of a tile: a tile of ones takes 8 MB at most.
ROWS, TILE = 4096, 256
#: Most groups that are broadcast; more are joined by a shuffle.
GROUPS = 20_000
#: Probabilities are counted in this unit.
UNIT = 1_000_000_000

COUNTS = "lang string, source string, term string, n long, df long"
CELLS = "lang string, a string, c long, b string, d long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source."""
    table = byte_table(digits=False)
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 65_536):
                part = terms[at : at + 65_536]
                names = pa.array(part, pa.binary()).cast(pa.string())
                numbers = [pa.array([c[t] for t in part], pa.int64()) for c in (n, df)]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), pa.repeat(source, len(part)), names, *numbers], names=["lang", "source", "term", "n", "df"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
            n, df = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(n), set()
            for terms in term_lists(text.as_py(), table):
                n.update(terms)
                seen.update(terms)
            df.update(seen)
            size += len(n) - before
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def kept_terms(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """``lang, term, total, counts``: the terms in at least ``min_docs`` documents of the language, ``counts`` being an array of
    (source, n) with a row for each source that has the term. Written, a task's rows in the order of their totals.

    Rows are dealt by (lang, term) once; both groupings follow that partitioning. A term has one row for each source and flush of a task.
    """
    src = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = src.mapInArrow(_count, COUNTS).repartition("lang", "term")
    own = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = own.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    kept = terms.where(F.col("df") >= min_docs).select("lang", "term", "total", "counts")
    return materialise(kept.sortWithinPartitions("lang", "total"), "audit-terms")


def block_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nonzero cells of the one-hot matrix' product with itself, for a < b, a block of rows after the other.

    ``batches`` have lang and counts. A block ends at ``ROWS`` rows or where it would have more than ``TILE`` columns; one row with more
    columns than that is multiplied tile by tile. Products are sums of ones below 2**53, so doubles are exact.
    """
    for batch in batches:
        lists = batch.column("counts")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        flat = lists.flatten()
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        langs, lang = _codes(batch.column("lang"))
        sources, source = _codes(flat.field("source"))
        code = lang[owner] * len(sources) + source
        levels, level = np.unique(flat.field("n").to_numpy(zero_copy_only=False), return_inverse=True)
        key = code * max(1, len(levels)) + level  # in the order of (group, level)
        cells = []
        at = 0
        while at < batch.num_rows:
            rows = min(ROWS, batch.num_rows - at)
            while True:
                span = slice(first[at], first[at + rows])
                columns, where = np.unique(key[span], return_inverse=True)
                if len(columns) <= TILE or rows == 1:
                    break
                rows //= 2
            named = np.stack([columns // max(1, len(levels)), levels[columns % max(1, len(levels))]], axis=1)
            cells.append(_product(named, where, owner[span] - at, rows))
            at += rows
        yield _cell_batch(langs, sources, cells)


def _product(columns: np.ndarray, where: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Rows (group a, level, group b, level, n) of the nonzero cells with a < b of the block whose ones are at (row, where)."""
    out = []
    tiles = []
    for low in range(0, len(columns), TILE):
        inside = (where >= low) & (where < low + TILE)
        ones = np.zeros((rows, min(TILE, len(columns) - low)))
        ones[row[inside], where[inside] - low] = 1
        tiles.append((low, ones))
    for k, (low_a, a) in enumerate(tiles):
        for low_b, b in tiles[k:]:
            joint = a.T @ b
            i, j = np.nonzero(joint)
            ca, cb = columns[low_a + i], columns[low_b + j]
            right = ca[:, 0] < cb[:, 0]  # columns are in the order of groups, so each pair of groups is met once
            out.append(np.concatenate([ca[right], cb[right], joint[i[right], j[right], None].astype(np.int64)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def _codes(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The sorted values of a column and the place of each row's value among them."""
    coded = column.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)]


def _cell_batch(langs: pa.Array, sources: pa.Array, parts: list[np.ndarray]) -> pa.RecordBatch:
    cells = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
    order = np.lexsort(cells[:, 3::-1].T)
    cells = cells[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(cells[:, :4], axis=0) != 0).any(axis=1)])[: len(cells)])
    keys, n = cells[new, :4], np.add.reduceat(cells[:, 4], new) if len(new) else np.zeros(0, np.int64)
    lang, a, b = keys[:, 0] // max(1, len(sources)), keys[:, 0] % max(1, len(sources)), keys[:, 2] % max(1, len(sources))
    arrays = [langs.take(pa.array(lang)), sources.take(pa.array(a)), pa.array(keys[:, 1]), sources.take(pa.array(b)), pa.array(keys[:, 3]), pa.array(n)]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "a", "c", "b", "d", "n"])


def chance(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + kept)), exact: the quotient of decimals is one of integers."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", top, (total + kept).cast("decimal(20,0)")) + 1


def price(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / q): both are at most UNIT + 1, so the square stays below 2**63."""
    return F.call_function("div", (p - q) * (p - q), q)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= GROUPS else df


def pair_values(terms: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language. ``groups`` has lang, source, total, kept (a row each)."""
    wide = lambda x: x.cast("decimal(38,0)")
    side = lambda s: _sized(groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), "kept" if s == "a" else F.lit(0).alias("_k")), n_groups)
    p = lambda s, level: chance(level, F.col(f"total_{s}"), F.col("kept"))
    zero = F.lit(0).cast("long")

    joint = terms.select("lang", "counts").mapInArrow(block_products, CELLS).groupBy("lang", "a", "c", "b", "d").agg(F.sum("n").alias("n"))
    cells = joint.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).drop("_k")
    priced = cells.select("lang", "a", "b", "n", *(p(s, lv).alias(f"{s}{k}") for s in "ab" for k, lv in (("1", F.col("c" if s == "a" else "d")), ("0", zero))))

    def both(of: str, to: str) -> Column:
        f = lambda i, j: wide(price(F.col(f"{of}{i}"), F.col(f"{to}{j}")))
        return F.struct(F.col(of).alias("source"), F.col(to).alias("item"), (wide(F.col("n")) * (f(1, 1) - f(1, 0) - f(0, 1) + f(0, 0))).alias("value"))

    cell_parts = priced.select("lang", F.explode(F.array(both("a", "b"), both("b", "a"))).alias("x")).select("lang", "x.*")

    level = terms.select("lang", F.explode("counts").alias("x")).groupBy("lang", F.col("x.source").alias("own"), F.col("x.n").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    owned = level.join(_sized(groups.select("lang", F.col("source").alias("own"), F.col("total").alias("total_a"), "kept"), n_groups), ["lang", "own"])
    met = owned.join(_sized(groups.select("lang", F.col("source").alias("other"), F.col("total").alias("total_b")), n_groups), "lang").where("own <> other")
    at = met.select("lang", "own", "other", "n", p("a", F.col("c")).alias("o1"), p("a", zero).alias("o0"), p("b", zero).alias("r0"))
    as_source = (wide(F.col("n")) * (wide(price(F.col("o1"), F.col("r0"))) - wide(price(F.col("o0"), F.col("r0"))))).alias("value")
    as_item = (wide(F.col("n")) * (wide(price(F.col("r0"), F.col("o1"))) - wide(price(F.col("r0"), F.col("o0"))))).alias("value")
    level_parts = at.select("lang", F.explode(F.array(F.struct(F.col("own").alias("source"), F.col("other").alias("item"), as_source), F.struct(F.col("other").alias("source"), F.col("own").alias("item"), as_item))).alias("x")).select("lang", "x.*")

    every = groups.select("lang", "source", F.col("total").alias("total_a"), "kept").join(_sized(groups.select("lang", F.col("source").alias("item"), F.col("total").alias("total_b")), n_groups), "lang").where("source <> item")
    none = F.when(F.col("kept") > 0, wide(F.col("kept")) * wide(price(p("a", zero), p("b", zero)))).otherwise(wide(zero))
    base = every.select("lang", "source", "item", none.alias("value"))
    whole = base.unionByName(cell_parts).unionByName(level_parts)
    return whole.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def term_values(terms: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """``lang, source, item, value`` for the terms that a source has more of than its language."""
    one = terms.select("lang", F.col("term").alias("item"), "total", F.explode("counts").alias("x")).select("lang", "item", "total", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
    got = one.join(_sized(groups.select("lang", "source", F.col("total").alias("own"), "kept", "lang_total"), n_groups), ["lang", "source"])
    p, q = chance(F.col("n"), F.col("own"), F.col("kept")), chance(F.col("total"), F.col("lang_total"), F.col("kept"))
    return got.select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"))


def source_audit(docs: DataFrame, min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: the sources of a language by their distance from each source (part pair, all of them), and the
    terms that a source has more of than its language, by how much (part term, the first ``top_terms``).

    Null text, lang or source is empty text. A source without kept terms has the smoothed chance of a count of 0 for each term; a language
    without kept terms gives pairs of value 0 and no terms. Repeated rows count as documents of their own, ids play no part, ties go
    by the item's bytes, an empty table gives an empty result, and other columns are ignored.
    """
    terms = kept_terms(docs, min_docs)
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    totals = terms.select("lang", F.explode("counts").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    seen = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    filled = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = materialise(seen.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *map(filled, ("total", "kept", "lang_total"))), "audit-groups")
    n_groups = groups.count()
    first = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = lambda df, part: df.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(first))
    pairs = ranked(pair_values(terms, groups, n_groups), "pair")
    top = ranked(term_values(terms, groups, n_groups), "term").where(F.col("rank") <= top_terms)
    return pairs.unionByName(top).select("lang", "source", "part", "item", "value", "rank")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(read_table(spark, sf_dir, "documents"))


_P = "(1 + ({unit}::HUGEINT * ({n} + 1)) // ({total} + {kept}))"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT row_number() OVER () AS r, * FROM d),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM o),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS cnt, {_P.format(unit=UNIT, n='coalesce(c.n, 0)', total='t.n', kept='l.v')} AS p, {_P.format(unit=UNIT, n='k.n', total='l.n', kept='l.v')} AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE cnt > 0 AND p > q)
SELECT *, cast(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 200
"""
