"""LM scoring: a trigram model in Elias-Fano tries, sharded by context, saved and memory-mapped.

    p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),  p2(w | v) = (c(v w) + A p1(w)) / (c(v) + A),
    p3(w | u v) = (c(u v w) + B p2(w | v)) / (c(u v) + B)

Each sums to 1 over the known words, the end of a text and one unknown word. A text's first token has no trigram context.

1. A chunk of documents becomes its distinct n-grams of each order with their training counts, dealt by context to shards
   (a frequent context by the whole n-gram), packed in one row for a chunk and shard: a hot word or n-gram is one entry of
   a chunk, whatever its share. The chunk's tokens wait in a file of the shared store.
2. A shard adds up the counts, builds its trie (orders 1 to 3), writes it (to the model's folder in the shared store, if the
   model is to be kept), maps it and looks the chunks' n-grams up. The values go back to the chunks.
3. A chunk puts the counts of all orders together and adds up each document's log10 probability.

The trie keeps log10 counts in 16 bits, so that a smoothed probability follows from the values of a few n-grams; no
shard needs another's counts. A saved model (``LanguageModel``) scores any other documents by steps 1 to 3.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import numtext as nt
from tideline.llm.elias_fano import SUCC_BITS, Level, Trie
from tideline.storage import materialise, new_path, read_table

U64 = np.uint64
#: Strength of the lower order, in counts, for bigrams and trigrams.
A, B = 2000.0, 20.0
#: Hashes that stand for the end of a text and for the context of its first word.
END, BEGIN = (1 << 48) - 1, (1 << 48) - 2
#: Contexts are not split below this share of all tokens: at most a million hot words go to the tasks.
LEAST_HOT = 1e-6
SAMPLE = 1 / 64


def is_held_out(id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def _tokens(texts: pa.Array) -> nt.Words:
    words = nt.hash_words(texts)
    return nt.Words(np.minimum(words.hashes >> U64(16), U64(BEGIN - 1)), words.first)


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in nt.chunks(batches, "text", 4 << 20):
        w, c = np.unique(_tokens(batch.column("text")).hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(c.astype(np.int64))], ["w", "c"])


@dataclass
class Grams:
    """The distinct n-grams of one order in a chunk: keys in the order of their shards, ``cuts`` bound each shard's; ``place``
    is the n-gram of each position (of ``at``), as an index of the unordered list."""

    keys: np.ndarray
    order: np.ndarray
    cuts: np.ndarray
    place: np.ndarray
    at: np.ndarray

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values in shard order as values of the positions."""
        own = np.empty(len(self.order), dtype=values.dtype)
        own[self.order] = values
        return own[self.place]


def _dealt(keys: np.ndarray, deal: np.ndarray, place: np.ndarray, at: np.ndarray, shards: int) -> Grams:
    shard = (deal % U64(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)
    order = np.argsort(keys, kind="stable")  # stable: the same order wherever it is computed again
    order = order[np.argsort(shard[order], kind="stable")]
    return Grams(keys[order], order, np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))]), place, at)


def grams(stream: np.ndarray, sizes: np.ndarray, names: np.ndarray, hot: np.ndarray, shards: int) -> list[Grams]:
    """Orders 1 to 3 of a chunk: ``stream`` are indices of ``names`` (sorted distinct hashes), ``sizes`` the tokens of each text.

    The key of an n-gram is a hash of its context and, below it, one of its last word. Inside a shard keys of different
    n-grams are equal with a chance of about the shard's n-grams in 2^56, or its successors of a context in 2^30.
    """
    every = np.arange(len(stream))
    first = np.zeros(len(stream), dtype=bool)
    first[np.cumsum(sizes) - sizes] = True
    n = len(names)
    known = np.append(names, U64(BEGIN))
    is_hot = np.append(np.isin(names, hot), True)
    tail = names >> U64(48 - SUCC_BITS)

    def keyed(context: np.ndarray, word: np.ndarray, by_whole: np.ndarray, place: np.ndarray, at: np.ndarray) -> Grams:
        keys = (context >> U64(38) << U64(SUCC_BITS)) | tail[word]
        return _dealt(keys, np.where(by_whole, nt.mix(context ^ names[word]), context), place, at, shards)

    one = _dealt(names, nt.mix(names), stream, every, shards)
    key, two = np.unique(np.where(first, n, np.roll(stream, 1)).astype(np.int64) * n + stream, return_inverse=True)
    before, word = key // n, key % n
    later = np.flatnonzero(~first)
    key, three = np.unique(two[later - 1] * n + stream[later], return_inverse=True)
    pair, last = key // n, key % n
    u, v = before[pair], word[pair]
    hashed = nt.mix(known)
    return [one, keyed(hashed[before], word, is_hot[before], two, every), keyed(nt.mix(hashed[u] + known[v]), last, is_hot[u] & is_hot[v], three, later)]


_ROWS = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("body", pa.binary()), ("ids", pa.list_(pa.int64()))])
_ROWS_SQL = "part bigint, bucket bigint, body binary, ids array<bigint>"
_VALUES = pa.schema([*_ROWS, ("file", pa.string()), ("n", pa.int64()), ("v", pa.int64()), ("e", pa.int64())])
_VALUES_SQL = _ROWS_SQL + ", file string, n bigint, v bigint, e bigint"


def _write(name: str, data: bytes) -> None:
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(name)
    store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(inside, compression=None) as f:
        f.write(data)


def _read(name: str) -> bytes:
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(name)
    with store.open_input_file(inside) as f:
        return f.read()


def _store(folder: str | None, shard: int, data: bytes) -> str:
    """Write a shard's trie; named by attempt, so that only the files of tasks that succeeded are in the manifest. Without a
    folder it goes to a file of the task's own, which is unlinked as soon as it is mapped."""
    from pyspark import TaskContext

    if folder is None:
        fd, name = tempfile.mkstemp(prefix="trie-")
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        return "file://" + name
    name = f"{folder}/trie-{shard:08d}-{TaskContext.get().taskAttemptId()}.ef"
    _write(name, data)
    return name


def _requests(shards: int, hot: np.ndarray, chunk_bytes: int, folder: str):
    """For each chunk one row for each shard with n-grams and training counts, and one with the name of the file (in the shared
    store, named by attempt) where the chunk's tokens wait for the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        for at, batch in enumerate(nt.chunks(batches, "text", chunk_bytes)):
            words, docs = _tokens(batch.column("text")), batch.num_rows
            sizes = words.counts + 1  # with an end after each text
            cur = np.full(len(words.hashes) + docs, END, dtype=U64)
            cur[np.arange(len(words.hashes)) + words.owner()] = words.hashes
            names, stream = np.unique(cur, return_inverse=True)
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
            weight = np.repeat(train, sizes)
            part = (task << 24) | at
            home = nt.join_blobs(nt.pack_planes(stream), nt.pack_planes(sizes), nt.pack_sorted(names), np.packbits(train.astype(np.uint8)).tobytes())
            name = f"{folder}/chunk-{part:012d}-{attempt}.bin"
            _write(name, home)
            rows = [{"part": part, "bucket": -1 - part, "body": name.encode(), "ids": batch.column("id").to_pylist()}]
            orders = grams(stream, sizes, names, hot, shards)
            counts = [np.bincount(g.place, weights=weight[g.at], minlength=len(g.order))[g.order].astype(np.int64) for g in orders]
            for b in range(shards):
                cuts = [slice(g.cuts[b], g.cuts[b + 1]) for g in orders]
                if any(s.stop > s.start for s in cuts):
                    body = [blob for g, c, s in zip(orders, counts, cuts, strict=True) for blob in (nt.pack_sorted(g.keys[s]), nt.pack_planes(c[s]))]
                    rows.append({"part": part, "bucket": b, "body": nt.join_blobs(*body)})
            yield pa.RecordBatch.from_pylist(rows, _ROWS)

    return run


def _opened(name: str) -> Trie:
    """The trie in a file of the shared store: mapped where the store is a file system, else read."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(name)
    if store.type_name == "local":
        return Trie.map(np.memmap(inside, dtype=np.uint8, mode="r"))
    return Trie.map(np.frombuffer(_read(name), dtype=np.uint8))


def _shard(train: bool, folder: str | None):
    """Look the n-grams of the chunks up in a shard's trie; with ``train`` the trie is built from their counts first."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, manifest: pa.Table) -> pa.Table:
        if not len(table):
            return pa.Table.from_pylist([], _VALUES)
        if key[0].as_py() < 0:
            return pa.Table.from_pylist(table.to_pylist(), _VALUES)
        parts, bodies = table["part"].to_pylist(), [nt.split_blobs(x) for x in table["body"].to_pylist()]
        orders, levels, seen = [], [], None
        for k in range(3):
            keys = np.concatenate([nt.unpack_sorted(x[2 * k]) for x in bodies])
            ends = np.cumsum([int.from_bytes(x[2 * k][1:7], "little") for x in bodies])
            order = np.argsort(keys)
            keys = keys[order]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            which = np.empty(len(order), dtype=np.int32)
            which[order] = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(np.append(new, len(order))))
            keys = keys[new]
            context, successor = (np.zeros(len(keys), U64), keys) if k == 0 else (keys >> U64(SUCC_BITS), keys & U64((1 << SUCC_BITS) - 1))
            orders.append((context, successor, which, ends))
            if train:
                count = np.concatenate([nt.unpack_planes(x[2 * k + 1]) for x in bodies])[order].astype(np.int64)
                count = np.add.reduceat(count, new) if len(new) else np.zeros(0, np.int64)
                got = count > 0
                levels.append(Level.build(context[got], successor[got], np.log10(count[got])))
                if k == 0:
                    seen = successor[got], count[got]
        del bodies, order, keys
        name = _store(folder, key[0].as_py(), Trie(levels).dump()) if train else manifest["file"][0].as_py() if len(manifest) else None
        trie = _opened(name) if name else None
        if train and folder is None:
            os.unlink(name.removeprefix("file://"))
        answers = [[] for _ in parts]
        for k, (context, successor, which, ends) in enumerate(orders):
            value = trie.levels[k].lookup(context, successor) if trie else np.full(len(context), -1.0)
            if k == 0:
                code = np.where(value < 0, 0, np.rint(10.0**value)).astype(U64)
                if seen is not None:  # counts above the precision of the codes
                    code[np.searchsorted(successor, seen[0])] = seen[1]
            else:
                code = np.where(value < 0, 0, np.rint(value / Level.STEP) + 1).astype(U64)
            for own, x in zip(answers, np.split(code[which], ends[:-1]), strict=True):
                own.append(nt.pack_planes(x))
        rows = [{"part": p, "bucket": -1 - p, "body": nt.join_blobs(key[0].as_py().to_bytes(8, "little"), *a)} for p, a in zip(parts, answers, strict=True)]
        if seen is not None:
            rows.append({"bucket": key[0].as_py(), "file": name if folder else None, "n": int(seen[1].sum()), "v": len(seen[0]), "e": int(seen[1][seen[0] == U64(END)].sum())})
        return pa.Table.from_pylist(rows, _VALUES)

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return run(key, table, table.slice(0, 0))

    return build if train else run


_RESULT_SQL = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _finish(shards: int, hot: np.ndarray, total: int, distinct: int, texts: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Put the values of one chunk's n-grams together and add up its documents."""
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        stream, sizes, names, bits = nt.split_blobs(_read(head["body"].decode()))
        stream, sizes, names = nt.unpack_planes(stream).astype(np.int64), nt.unpack_planes(sizes).astype(np.int64), nt.unpack_sorted(names)
        train = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(sizes)].astype(bool)
        orders = grams(stream, sizes, names, hot, shards)
        codes = [np.zeros(len(g.order), dtype=np.int64) for g in orders]
        for r in rows:
            if r["ids"] is None:
                shard, *answers = nt.split_blobs(r["body"])
                b = int.from_bytes(shard, "little")
                for g, c, x in zip(orders, codes, answers, strict=True):
                    c[g.cuts[b] : g.cuts[b + 1]] = nt.unpack_planes(x)
        count = lambda code: np.where(code > 0, 10.0 ** ((code - 1) * Level.STEP), 0.0)
        c1, c2, c3 = codes[0], count(codes[1]), count(codes[2])
        c1, c2, c3 = (g.spread(c) for g, c in zip(orders, (c1, c2, c3), strict=True))
        start = np.cumsum(sizes) - sizes
        floor = total + 0.1 * (distinct + 1)
        p = (c1 + 0.1) / floor
        base = np.log10(p)
        before = np.roll(c1, 1).astype(np.float64)
        before[start] = texts
        p = (c2 + A * p) / (before + A)
        later = orders[2].at
        p[later] = (c3 + B * p[later]) / (c2[later - 1] + B)
        add = lambda x: np.add.reduceat(x, start)
        return pa.table(
            {
                "id": pa.array(head["ids"], pa.int64()),
                "held_out": pa.array(~train),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(add((c1 > 0).astype(np.int64))),
                "base_score": pa.array(add(base)),
                "score": pa.array(add(np.log10(p))),
            }
        )

    return run


@dataclass
class LanguageModel:
    """A trained model: a manifest of the shards' files, and what every task needs to know."""

    manifest: DataFrame
    shards: int
    hot: np.ndarray
    total: int
    distinct: int
    texts: int

    def save(self, path: str) -> None:
        """Write the model's table to ``path``; the tries stay where the training put them."""
        spark = self.manifest.sparkSession
        self.manifest.write.parquet(f"{path}/manifest")
        row = (self.shards, self.hot.astype(np.int64).tolist(), self.total, self.distinct, self.texts)
        spark.createDataFrame([row], "shards int, hot array<bigint>, total bigint, distinct bigint, texts bigint").write.parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LanguageModel:
        r = spark.read.parquet(f"{path}/model").first()
        return cls(spark.read.parquet(f"{path}/manifest"), r["shards"], np.array(r["hot"], dtype=U64), r["total"], r["distinct"], r["texts"])

    def score(self, docs: DataFrame, text: str = "text", id: str = "doc_id", chunk_bytes: int = 4 << 20) -> DataFrame:
        """The rows of ``lm_score`` for documents the model was not trained on (all marked held out)."""
        src = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.lit(False).alias("train"))
        chunks = new_path(docs.sparkSession, "lm-chunks")
        asked = src.mapInArrow(_requests(self.shards, self.hot, chunk_bytes, chunks), _ROWS_SQL).repartition(self.shards, "bucket")
        values = asked.groupBy("bucket").cogroup(self.manifest.groupBy("bucket")).applyInArrow(_shard(False, None), _VALUES_SQL)
        return self.finish(values, id)

    def finish(self, values: DataFrame, id: str) -> DataFrame:
        own = values.where("part is not null").select("part", "body", "ids").repartition(self.shards, "part")
        out = own.groupBy("part").applyInArrow(_finish(self.shards, self.hot, self.total, self.distinct, self.texts), _RESULT_SQL)
        return out.select(F.col("id").alias(id), "held_out", "n_tokens", "n_known", F.lit(self.total).cast("long").alias("train_tokens"), "base_score", "score")


def train_and_score(docs: DataFrame, held_out: Column, text: str = "text", id: str = "doc_id", folder: str | None = None, chunk_bytes: int = 6 << 20, shard_bytes: int = 8 << 20, hot_share: float | None = None) -> tuple[LanguageModel, DataFrame]:
    """A model of the rows where ``held_out`` is false, and the scores of all rows. With ``folder`` the tries are written there
    and the model can be saved and used again; without it they last as long as their tasks (a third less disk)."""
    spark = docs.sparkSession
    src = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), (~held_out).alias("train"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    # Which contexts are split is a matter of balance alone, so a sample may decide it; results do not depend on it.
    words = src.select("text").sample(False, SAMPLE, 1).mapInArrow(_sample_counts, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c"))
    words = materialise(words, "lm-sample")
    share = max(LEAST_HOT, 1 / (4 * shards)) if hot_share is None else hot_share
    line = share * (words.agg(F.sum("c")).first()[0] or 0)
    hot = np.array(sorted(r["w"] for r in words.where(F.col("c") > line).collect()), dtype=U64)  # at most 1 / share rows

    asked = src.mapInArrow(_requests(shards, hot, chunk_bytes, new_path(spark, "lm-chunks")), _ROWS_SQL).repartition(shards, "bucket")
    values = materialise(asked.groupBy("bucket").applyInArrow(_shard(True, folder), _VALUES_SQL), "lm-values")
    got = values.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "e"))).first()
    model = LanguageModel(values.where("file is not null").select("bucket", "file"), shards, hot, got["n"], got["v"], got["e"])
    return model, model.finish(values, id)


def lm_score(docs: DataFrame, held_out: Column, **options) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Learns from the rows where ``held_out`` is false. A null or empty text is its end alone. Repeated rows count
    and are scored each; a null id counts as not held out unless the column says so. An empty table gives an empty
    result; without training rows every score is the uniform base. Other columns are ignored.
    """
    return train_and_score(docs, held_out, **options)[1]


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(read_table(spark, sf_dir, "documents"), is_held_out(F.col("doc_id")))
