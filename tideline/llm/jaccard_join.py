"""N-gram Jaccard join by signature trees.

1. Each text becomes a set of 48-bit shingle hashes; equal sets collapse to one.
2. Shingles are dealt by hash range, packed (sorted differences, one row for a chunk and range), and counted. Only
   shingles that two sets or more hold come back to their chunk: no other can be in an overlap. The number of
   ranges grows with the bytes of text.
3. A set whose shared shingles could not reach the threshold is done. The others publish their rarest shingles (prefix
   filter in global frequency order: a linked pair must share one of them). The sets of a published shingle are a posting.
4. A star round links sets cheaply: each set of a posting is verified against a few hubs, and takes the label of a hub that it
   links to. Postings of one label are done. While a posting is too long for one task, further rounds verify a representative of
   each component, as long as that merges many. Only verified links make components.
5. The postings that are left get signature trees: inner nodes hold OR-combined token bitmaps, size ranges and ranges of
   components. A dual traversal of a tree with itself prunes node pairs by size, by the largest possible overlap (common bits
   and bit collisions) and where all sets are connected already. The upper levels of a long posting (size classes, then digits of a
   hash, down to ``leaf_sets``) are traversed as Spark joins, the rest of each surviving pair of subtrees in one task. Of the
   pairs of sets that are left, the likeliest of each two components are verified first, with the shingles; then the trees are traversed
   once more with the components that this gave, and every pair that is left is verified.

The join is exact up to 48-bit hash collisions inside one pair of sets (below 1e-9 for texts of 500 words).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import numtext as nt
from tideline.operators.graph import connected_components
from tideline.operators.spread import hot_keys, salted_join, spread_join
from tideline.storage import materialise, read_table

U64 = np.uint64
TOKEN_BITS = 48
#: Words of a set's bitmap (4,096 bits) and of the folded ones (1,024 bits) of the upper nodes.
WORDS, UPPER = 64, 16
#: Bytes of text that a task hashes at once (about 35 bytes of memory for each), and slices in which it counts a hash range.
HASH_BYTES, SLICES = 1 << 19, 16
#: Bits of a hash for one step down the upper tree, and children of a node below.
STEP, FAN = 4, 16


@dataclass(frozen=True)
class Spec:
    """Shingles of ``k`` words; linked when the Jaccard similarity is at least ``num / den``.

    The rest shapes the plan only: text bytes of a chunk and of a hash range, sets of a tree's leaf, hubs of a star round
    and the largest number of such rounds, and pairs of two components of a posting that are verified before all others.
    """

    k: int = 5
    num: int = 4
    den: int = 5
    chunk_bytes: int = 4 << 20
    range_bytes: int = 16 << 20
    leaf_sets: int = 4096
    hubs: int = 3
    star_rounds: int = 8
    likeliest: int = 3


_MAPPED = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("toks", pa.binary()), ("ords", pa.binary()), ("meta", pa.binary()), ("docs", pa.list_(pa.int64()))])
_MAPPED_SQL = "part bigint, bucket bigint, toks binary, ords binary, meta binary, docs array<bigint>"
_COUNTED = pa.schema([("part", pa.int64()), ("toks", pa.binary()), ("ords", pa.binary()), ("dfs", pa.binary()), ("meta", pa.binary()), ("docs", pa.list_(pa.int64()))])
_COUNTED_SQL = "part bigint, toks binary, ords binary, dfs binary, meta binary, docs array<bigint>"
_SETS = pa.schema([("set_id", pa.binary()), ("n", pa.int64()), ("docs", pa.list_(pa.int64())), ("toks", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64())), ("clash", pa.int64()), ("clash_up", pa.int64())])
_SETS_SQL = "set_id binary, n bigint, docs array<bigint>, toks array<bigint>, keys array<bigint>, sig array<bigint>, clash bigint, clash_up bigint"


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, token, size)``: distinct tokens sorted by owner and token, and the exact set size of each text.

    Texts are hashed piece by piece; a text longer than ``HASH_BYTES`` is a piece of its own.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    parts, at = [_piece_sets(texts.slice(0, 0), k)], 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HASH_BYTES, side="right")))
        own, tok, sizes = _piece_sets(texts.slice(at, stop - at), k)
        parts.append((own + at, tok, sizes))
        at = stop
    own, tok, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    return own, tok, sizes


def _piece_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = nt.hash_words(texts)
    owner, h = nt.shingles(words, k)
    packed = np.unique((owner.astype(U64) << U64(TOKEN_BITS)) | (h >> U64(64 - TOKEN_BITS)))
    own, tok = (packed >> U64(TOKEN_BITS)).astype(np.int64), packed & U64((1 << TOKEN_BITS) - 1)
    sizes = np.bincount(own, minlength=len(texts))
    if len(np.unique(nt.mix(h + owner.astype(U64) * U64(0xA0761D6478BD642F)))) != len(packed):  # two shingles of a text share a token
        for d in range(len(texts)):
            sizes[d] = len(np.unique(h[owner == d]))
    return own, tok, sizes


def _digests(own: np.ndarray, tok: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16 bytes for each text, equal for equal sets."""
    out = np.zeros((len(sizes), 2), dtype=U64)
    starts = np.searchsorted(own, np.flatnonzero(sizes))
    if len(starts):
        out[sizes > 0, 0] = np.add.reduceat(nt.mix(tok + U64(0x2545F4914F6CDD1D)), starts)
        out[sizes > 0, 1] = np.add.reduceat(nt.mix(tok ^ U64(0x5851F42D4C957F2D)), starts)
    out[:, 1] += sizes.astype(U64)
    return out


def _map(spec: Spec, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for at, batch in enumerate(nt.chunks(batches, "text", spec.chunk_bytes)):
            part = (task << 24) | at
            own, tok, sizes = shingle_sets(batch.column("text"), spec.k)
            ids = _digests(own, tok, sizes)
            uniq, first, which = np.unique(ids.view("V16").reshape(-1), return_index=True, return_inverse=True)
            alone = first[which] == np.arange(len(ids))  # the first text with each set
            used = alone[own]
            own, tok = which[own[used]].astype(U64), tok[used]
            order = np.argsort(tok, kind="stable")
            own, tok = own[order], tok[order]
            docs = batch.column("id")
            grouped = np.argsort(which, kind="stable")
            rows = [
                {
                    "part": part,
                    "bucket": -1 - part,
                    "meta": uniq.tobytes() + sizes[first].astype(np.int64).tobytes() + np.bincount(which, minlength=len(uniq)).astype(np.int64).tobytes(),
                    "docs": docs.take(pa.array(grouped)).to_pylist(),
                }
            ]
            cuts = np.searchsorted(tok, np.array([(b << TOKEN_BITS) // buckets for b in range(buckets + 1)], dtype=U64))
            for b in range(buckets):
                lo, hi = cuts[b], cuts[b + 1]
                if hi > lo:
                    rows.append({"part": part, "bucket": b, "toks": nt.pack_sorted(tok[lo:hi]), "ords": nt.pack_planes(own[lo:hi])})
            yield pa.RecordBatch.from_pylist(rows, _MAPPED)

    return run


def _count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Shingles of one hash range that occur in two sets or more, back to their chunks."""
    if key[0].as_py() < 0:
        return table.select(["part", "toks", "ords"]).append_column("dfs", pa.nulls(len(table), pa.binary())).append_column("meta", table["meta"]).append_column("docs", table["docs"]).cast(_COUNTED)
    parts = table["part"].to_numpy()
    toks = [nt.unpack_sorted(x) for x in table["toks"].to_pylist()]
    ords = [nt.unpack_planes(x).astype(np.int32) for x in table["ords"].to_pylist()]
    low, high = min(int(t[0]) for t in toks), max(int(t[-1]) for t in toks) + 1
    bounds = np.array([low + (high - low) * i // SLICES for i in range(SLICES + 1)], dtype=U64)
    cuts = [np.searchsorted(t, bounds) for t in toks]
    held: list[list[tuple]] = [[] for _ in toks]
    for i in range(SLICES):
        _count_slice([t[c[i] : c[i + 1]] for t, c in zip(toks, cuts, strict=True)], [o[c[i] : c[i + 1]] for o, c in zip(ords, cuts, strict=True)], held)
    rows = [
        {"part": int(part), "toks": nt.pack_sorted(tok), "ords": nt.pack_planes(own), "dfs": nt.pack_planes(df)}
        for part, pieces in zip(parts, held, strict=True)
        if pieces
        for tok, own, df in [map(np.concatenate, zip(*pieces, strict=True))]
    ]
    return pa.Table.from_pylist(rows, _COUNTED)


def _count_slice(toks: list[np.ndarray], ords: list[np.ndarray], held: list[list[tuple]]) -> None:
    """Appends the shingles, owners and counts of a slice that occur in two sets or more to what is held of their chunks."""
    which = np.repeat(np.arange(len(toks), dtype=np.int32), [len(t) for t in toks])
    tok = np.concatenate(toks)
    order = np.argsort(tok, kind="stable")
    tok = tok[order]
    edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])[: len(tok)])
    runs = np.diff(np.append(edge, len(tok)))
    df = np.repeat(runs, runs)
    keep = df > 1
    tok, df, order = tok[keep], np.minimum(df[keep], 65_535).astype(np.int32), order[keep]
    ords, which = np.concatenate(ords)[order], which[order]
    back = np.argsort(which, kind="stable")
    tok, df, ords = tok[back], df[back], ords[back]
    cuts = np.searchsorted(which[back], np.arange(len(toks) + 1))
    for pieces, a, b in zip(held, cuts[:-1], cuts[1:], strict=True):
        if b > a:
            pieces.append((tok[a:b], ords[a:b], df[a:b]))


def _assemble(spec: Spec):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The sets of one chunk: those that can link at all keep their shared tokens and publish their rarest ones."""
        rows = table.to_pylist()
        head = next(r for r in rows if r["meta"] is not None)
        sets = len(head["meta"]) // 32
        ids = [head["meta"][16 * i : 16 * i + 16] for i in range(sets)]
        n, held = np.frombuffer(head["meta"], np.int64, offset=16 * sets).reshape(2, sets)
        body = [r for r in rows if r["meta"] is None]
        cat = lambda f, c: np.concatenate([f(r[c]) for r in body]) if body else np.zeros(0, U64)
        tok, own, df = cat(nt.unpack_sorted, "toks"), cat(nt.unpack_planes, "ords").astype(np.int64), cat(nt.unpack_planes, "dfs").astype(np.int64)
        shared = np.bincount(own, minlength=sets)
        able = (shared * spec.den >= spec.num * n) & (n > 0)
        pick = able[own]
        tok, own, df = tok[pick], own[pick], df[pick]
        order = np.lexsort((tok, df, own))
        tok, own = tok[order], own[order]
        cuts = np.searchsorted(own, np.arange(sets + 1))
        ends = np.concatenate([[0], np.cumsum(held)])
        out = []
        for i in range(sets):
            row = {"set_id": ids[i], "n": int(n[i]), "docs": head["docs"][ends[i] : ends[i + 1]]}
            if able[i]:
                mine = tok[cuts[i] : cuts[i + 1]]
                prefix = int(n[i] - -(-int(n[i]) * spec.num // spec.den) + 1 - (n[i] - shared[i]))
                bits = np.zeros(64 * WORDS, dtype=np.uint8)
                bits[(mine % U64(64 * WORDS)).astype(np.int64)] = 1
                row["toks"] = mine.astype(np.int64)
                row["keys"] = mine[: max(prefix, 0)].astype(np.int64)
                row["sig"] = np.packbits(bits, bitorder="little").view(np.int64)
                row["clash"] = len(mine) - int(bits.sum())
                row["clash_up"] = len(mine) - int(bits.reshape(-1, 64 * UPPER).max(axis=0).sum())
            out.append(row)
        return pa.Table.from_pylist(out, _SETS)

    return run


def _alike(n1: Column, n2: Column, spec: Spec) -> Column:
    """Sizes that allow a link."""
    return (n1 * spec.den >= spec.num * n2) & (n2 * spec.den >= spec.num * n1)


def _reach(common: Column, clash1: Column, clash2: Column, least1: Column, least2: Column, spec: Spec) -> Column:
    """Whether the largest possible overlap allows a link of two sets, or of any two sets under two nodes."""
    return (common + F.least(clash1, clash2)) * (spec.num + spec.den) >= spec.num * (least1 + least2)


def _verify(pairs: DataFrame, able: DataFrame, spec: Spec) -> DataFrame:
    """The pairs (a, b; a written table) that link: bitmaps first, then the shingles."""
    hot = hot_keys(pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))), ["x"])

    def with_side(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
        one = able.select(F.col("set_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
        return salted_join(df, one, [side], F.col("b" if side == "a" else "a"), hot and hot.withColumnRenamed("x", side))

    near = with_side(with_side(pairs, "a", ["n", "clash", "sig"]), "b", ["n", "clash", "sig"])
    shared = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    near = near.where(_reach(shared, F.col("clash_a"), F.col("clash_b"), F.col("n_a"), F.col("n_b"), spec)).drop("sig_a", "sig_b")
    full = with_side(with_side(near, "a", ["toks"]), "b", ["toks"])
    common = F.size(F.array_intersect("toks_a", "toks_b")).cast("long")
    return full.where(common * (spec.num + spec.den) >= spec.num * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _still_open(postings: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Postings in which more than one component meets."""
    mixed = postings.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return materialise(salted_join(postings, mixed, ["key"], F.col("set_id"), hot, "left_semi"), "jaccard-postings")


def _star(postings: DataFrame, able: DataFrame, hot: DataFrame | None, spec: Spec, turn: int) -> tuple[DataFrame, int]:
    """Verified links of the representatives of each posting's components with the posting's hubs, and the number of pairs tried."""
    first = F.min_by(F.struct("set_id", "n"), F.xxhash64("set_id", F.lit(turn)))
    reps = materialise(postings.groupBy("key", "label").agg(first.alias("r")).select("key", "label", "r.set_id", "r.n"), "jaccard-reps") if turn else postings
    hub = lambda k: F.min_by(F.struct("set_id", "n", "label"), F.xxhash64("label", F.lit(turn * spec.hubs + k)))
    hubs = reps.groupBy("key").agg(F.array_distinct(F.array(*(hub(k) for k in range(spec.hubs)))).alias("hubs"))
    met = salted_join(reps, hubs, ["key"], F.col("set_id"), hot).select("set_id", "n", "label", F.explode("hubs").alias("h"))
    pairs = met.where((F.col("label") != F.col("h.label")) & _alike(F.col("n"), F.col("h.n"), spec)).select(F.col("h.set_id").alias("a"), F.col("set_id").alias("b")).distinct()
    pairs = materialise(pairs, "jaccard-pairs")
    return materialise(_verify(pairs, able, spec), "jaccard-links"), pairs.count()


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _lower_levels(sig: np.ndarray, n: np.ndarray, clash: np.ndarray, label: np.ndarray) -> list[tuple]:
    """Levels of a tree from the sets up: bitmaps, smallest and largest size, largest clash, smallest and largest label."""
    levels = [(sig, n, n, clash, label, label)]
    while len(levels[-1][0]) > 1:
        s, lo, hi, c, l0, l1 = levels[-1]
        at = np.arange(0, len(s), FAN)
        reduced = (np.minimum, lo), (np.maximum, hi), (np.maximum, c), (np.minimum, l0), (np.maximum, l1)
        levels.append((np.bitwise_or.reduceat(s, at, axis=0), *(f.reduceat(v, at) for f, v in reduced)))
    return levels


def tree_pairs(left: list[tuple], right: list[tuple] | None, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of different labels that the dual traversal of two trees (of one with itself) leaves."""
    own = right is None
    right = left if own else right
    depth = max(len(left), len(right)) - 1
    at = lambda tree, level: tree[min(level, len(tree) - 1)]
    i, j = np.zeros(1, np.int32), np.zeros(1, np.int32)
    for level in range(depth, -1, -1):
        p, q = at(left, level), at(right, level)
        ok = (p[2][i] * spec.den >= spec.num * q[1][j]) & (q[2][j] * spec.den >= spec.num * p[1][i])
        ok &= ~((p[4][i] == p[5][i]) & (q[4][j] == q[5][j]) & (p[4][i] == q[4][j]))
        some = np.flatnonzero(ok)
        for k in range(0, len(some), 8192):
            x = some[k : k + 8192]
            most = np.bitwise_count(p[0][i[x]] & q[0][j[x]]).sum(axis=1, dtype=np.int64) + np.minimum(p[3][i[x]], q[3][j[x]])
            ok[x] = most * (spec.num + spec.den) >= spec.num * (p[1][i[x]] + q[1][j[x]])
        i, j = i[ok], j[ok]
        if level:
            f = np.arange(FAN, dtype=np.int32)
            split = lambda v, tree: (v[:, None] * FAN + f) if level < len(tree) else v[:, None]  # noqa: E731, B023
            x, y = split(i, left), split(j, right)
            i, j = np.repeat(x, y.shape[1], axis=1).reshape(-1), np.tile(y, (1, x.shape[1])).reshape(-1)
            inside = (i < len(at(left, level - 1)[0])) & (j < len(at(right, level - 1)[0]))
            if own:
                inside &= i <= j
            i, j = i[inside], j[inside]
    return (i[i != j], j[i != j]) if own else (i, j)


def _likeliest(a: np.ndarray, b: np.ndarray, common: np.ndarray, best: int) -> np.ndarray:
    """The places of the ``best`` pairs of each two labels with the most bits in common."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((-common, high, low))
    x, y = low[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(x)])
    rank = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return order[rank < best]


def _leaf_pairs(spec: Spec, best: int | None):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The pairs that are left of each ``unit`` of the table: one posting (side 0) or two subtrees (sides 1 and 2); the likeliest
        ``best`` of each two components, or all."""
        column = lambda c: table[c].to_numpy()
        unit, side, n, clash, label = (column(c) for c in ("unit", "side", "n", "clash", "lab"))
        sig = table["sig"].combine_chunks().flatten().to_numpy().view(U64).reshape(-1, WORDS)
        coded = table["set_id"].combine_chunks().dictionary_encode()
        ranked = pc.array_sort_indices(coded.dictionary)
        names, place = coded.dictionary.take(ranked), np.empty(len(ranked), np.int64)
        place[ranked.to_numpy()] = np.arange(len(ranked))
        code, order = place[coded.indices.to_numpy()], np.lexsort((n, label, unit))
        out = [np.zeros(0, np.int64)]  # pairs as numbers, the smaller id first
        for rows in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            parts = [rows[side[rows] == k] for k in (0, 1, 2)]
            trees = [_lower_levels(sig[r], n[r], clash[r], label[r]) if len(r) else None for r in parts]
            for a, b in ((0, None), (1, 2)):
                if trees[a] is not None and (b is None or trees[b] is not None):
                    i, j = tree_pairs(trees[a], None if b is None else trees[b], spec)
                    i, j = parts[a][i], parts[a if b is None else b][j]
                    if best is not None and len(i) > best:
                        common = np.concatenate([np.bitwise_count(sig[i[k : k + 8192]] & sig[j[k : k + 8192]]).sum(axis=1, dtype=np.int32) for k in range(0, len(i), 8192)])
                        some = _likeliest(label[i], label[j], common, best)
                        i, j = i[some], j[some]
                    x, y = code[i], code[j]
                    out.append(np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y)))
            if sum(map(len, out[1:])) > max(len(out[0]), 1 << 20):
                out = [np.unique(np.concatenate(out))]
        keys = np.unique(np.concatenate(out))
        return pa.table([names.take(pa.array(keys // max(1, len(names)))), names.take(pa.array(keys % max(1, len(names))))], schema=_PAIR)

    return run


def _traverse(postings: DataFrame, able: DataFrame, hot: DataFrame | None, spec: Spec, best: int | None = None) -> DataFrame:
    """``a, b``: the pairs of sets of different components that the dual traversal of the postings' trees leaves; of a posting or of two
    subtrees the likeliest ``best`` of each two components, or all."""
    count = postings.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    main = count.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    cls = F.floor(F.log(F.col("n").cast("double") + 1e-9) / math.log(spec.den / spec.num)).cast("int")
    tagged = salted_join(postings, main, ["key"], F.col("set_id"), hot).select("key", "set_id", "n", "label", (F.col("label") == F.col("main")).alias("in_main"), cls.alias("cls"), F.lpad(F.hex(F.xxhash64("set_id")), 16, "0").alias("h"))
    tagged = materialise(tagged, "jaccard-tagged")
    top = ["key", "in_main", "cls"]
    steps = F.greatest(F.lit(0), F.least(F.lit(16), F.ceil(F.log(F.col("m") / spec.leaf_sets) / math.log(1 << STEP)))).cast("int")
    heights = tagged.groupBy(*top).agg(F.count(F.lit(1)).alias("m")).select(*top, steps.alias("height"))
    tall = materialise(heights.groupBy("key").agg(F.max("height").alias("tallest")).where("tallest > 0"), "jaccard-tall")
    levels = tall.agg(F.max("tallest")).first()[0] or 0

    flat = tagged if not levels else salted_join(tagged, tall.select("key"), ["key"], F.col("set_id"), hot, "left_anti")
    units = flat.select(F.col("key").alias("unit"), F.lit(0).alias("side"), "set_id", "n", "label")
    if levels:
        deep = salted_join(salted_join(tagged, tall.select("key"), ["key"], F.col("set_id"), hot, "left_semi"), heights, top, F.col("set_id"), hot)
        deep = materialise(deep.join(able.select("set_id", "sig", "clash_up"), "set_id"), "jaccard-deep")
        name = lambda d: F.concat_ws(".", F.col("in_main").cast("int"), "cls", F.substring("h", 1, F.least(F.lit(d), F.col("height"))))
        fold = lambda k: F.get("sig", F.lit(k)).bitwiseOR(F.get("sig", F.lit(k + UPPER))).bitwiseOR(F.get("sig", F.lit(k + 2 * UPPER))).bitwiseOR(F.get("sig", F.lit(k + 3 * UPPER)))
        pairs = None
        for d in range(levels + 1):
            bits = [F.bit_or(fold(k)).alias(f"s{k}") for k in range(UPPER)]
            nodes = deep.groupBy("key", name(d).alias("node"), name(max(d - 1, 0)).alias("up")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("clash_up").alias("clash"), F.min("label").alias("l0"), F.max("label").alias("l1"), *bits)
            nodes = materialise(nodes, "jaccard-nodes")
            rename = lambda s: nodes.select("key", *(F.col(c).alias(f"{c}_{s}") for c in nodes.columns if c != "key"))  # noqa: E731, B023
            met = rename("a").join(rename("b"), "key") if pairs is None else pairs.join(rename("a"), ["key", "up_a"]).join(rename("b"), ["key", "up_b"])
            c = F.col
            sizes = (c("hi_a") * spec.den >= spec.num * c("lo_b")) & (c("hi_b") * spec.den >= spec.num * c("lo_a"))
            joined = (c("l0_a") == c("l1_a")) & (c("l0_b") == c("l1_b")) & (c("l0_a") == c("l0_b"))
            common = sum((F.bit_count(c(f"s{k}_a").bitwiseAND(c(f"s{k}_b"))).cast("long") for k in range(UPPER)), F.lit(0).cast("long"))
            kept = met.where((c("node_a") <= c("node_b")) & sizes & ~joined & _reach(common, c("clash_a"), c("clash_b"), c("lo_a"), c("lo_b"), spec))
            pairs = materialise(kept.select("key", c("node_a").alias("up_a"), c("node_b").alias("up_b")), "jaccard-node-pairs")
        same = F.col("up_a") == F.col("up_b")
        sides = F.explode(F.array_compact(F.array(F.struct(F.when(same, 0).otherwise(1).alias("side"), F.col("up_a").alias("node")), F.when(~same, F.struct(F.lit(2).alias("side"), F.col("up_b").alias("node"))))))
        wanted = pairs.select("key", F.xxhash64("key", "up_a", "up_b").alias("unit"), sides.alias("x")).select("key", "unit", "x.side", "x.node")
        members = deep.select("key", name(16).alias("node"), "set_id", "n", "label")
        units = units.unionByName(wanted.join(members, ["key", "node"]).select("unit", "side", "set_id", "n", "label"))
    full = units.join(able.select("set_id", "sig", "clash"), "set_id").withColumn("lab", F.xxhash64("label"))
    buckets = max(1, postings.count() // 4096)
    dealt = full.withColumn("bucket", F.pmod(F.xxhash64("unit"), F.lit(buckets))).select("bucket", "unit", "side", "set_id", "n", "lab", "clash", "sig").repartition(min(buckets, 100_000), "bucket")
    return dealt.groupBy("bucket").applyInArrow(_leaf_pairs(spec, best), "a binary, b binary").distinct()


def _components(able: DataFrame, spec: Spec) -> DataFrame:
    """``set_id, label`` of the sets with links: sets with the same label are connected by links."""
    postings = materialise(able.select(F.explode("keys").alias("key"), "set_id", "n", F.col("set_id").alias("label")), "jaccard-postings")
    hot = hot_keys(postings, ["key"])
    postings, links = _still_open(postings, hot), None
    merged = lambda labels: _still_open(postings.drop("label").join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")), hot)
    for turn in range(spec.star_rounds):
        longest = postings.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        if not longest or (turn and longest <= spec.leaf_sets):
            break
        found, tried = _star(postings, able, hot, spec, turn)
        n = found.count()
        if n:
            links = found if links is None else links.unionByName(found)
            postings = merged(_labels(links))
        if n * 4 <= tried:
            break
    for best in (spec.likeliest, None):
        # One link joins two components, so the likeliest pairs come first; what they join needs no others.
        found = materialise(_verify(materialise(_traverse(postings, able, hot, spec, best), "jaccard-pairs"), able, spec), "jaccard-links")
        links = found if links is None else links.unionByName(found)
        if best is not None:
            postings = merged(_labels(links))
    return _labels(links)


def _labels(links: DataFrame) -> DataFrame:
    return materialise(connected_components(links, "a", "b", written=True).select(F.col("node").alias("set_id"), F.col("component").alias("label")), "jaccard-labels")


def jaccard_join(docs: DataFrame, spec: Spec, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id, n_shingles, component_id, class_id``, one row for each row of ``docs``.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable by links. Null and
    empty texts have an empty set, link with nothing and are their own class and component. Repeated ids are rows of
    their own and fall in one class when their sets agree; a null id takes part and shows the smallest other id of its
    component, or null. An empty table gives an empty result; other columns are ignored.
    """
    src = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // spec.range_bytes))
    mapped = src.mapInArrow(_map(spec, ranges), _MAPPED_SQL).repartition(ranges, "bucket")
    counted = mapped.groupBy("bucket").applyInArrow(_count, _COUNTED_SQL).repartition(ranges, "part")
    sets = materialise(counted.groupBy("part").applyInArrow(_assemble(spec), _SETS_SQL), "jaccard-sets")

    able = materialise(sets.where("toks is not null").dropDuplicates(["set_id"]).select("set_id", "n", "toks", "keys", "sig", "clash", "clash_up"), "jaccard-able")
    labels = _components(able, spec)

    rows = sets.select("set_id", "n", F.explode("docs").alias("id"))
    classes = rows.where("n > 0").groupBy("set_id").agg(F.min("id").alias("class_id")).join(labels, "set_id", "left")
    classes = materialise(classes.select("set_id", "class_id", F.coalesce("label", "set_id").alias("label")), "jaccard-classes")
    comps = classes.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = spread_join(classes, comps, ["label"], F.col("set_id")).select("set_id", "class_id", "component_id")
    return spread_join(rows, named, ["set_id"], F.col("id"), "left").select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
    )


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"), Spec(k=3, num=9, den=10))
