"""Byte-level BPE with the tokenizers library over Arrow batches.

A rank file gives the vocabulary; the merges follow from it: every split of a token into two tokens is a
merge of that token's rank, so that any pair whose bytes form a token may merge, lowest rank first. Bytes are mapped to
printable characters for the library. Decoding joins the tokens' characters, reverses the byte table and only then decodes
UTF-8, so characters split over tokens come back whole. Offsets are in characters of the text; a token that holds a part
of a character has the span of the whole one. The vocabulary file is a parameter; each Python worker loads it once.
Where no match of the pattern goes on from a non-space to a space, or from letters to punctuation (but an apostrophe), a word with
the spaces before it encodes alike in every text, and a worker encodes each word once while there is room for it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tideline.storage import read_table

SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # \s of the libraries
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
WORDS = re.compile(f"[{SPACES}]*[{LETTERS}]+(?=[!-&(-/:-@])|[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")


@functools.cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return [out[b] for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = load_ranks(path)
        chars = byte_chars()
        shown = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            merges += [(shown[token[:k]], shown[token[k:]]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.shown = {r: shown[t] for t, r in ranks.items()}
        self.byte_of = np.zeros(512, dtype=np.uint8)  # the byte table reversed
        self.byte_of[[ord(c) for c in chars]] = np.arange(256)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_ends(self, texts: list[str]) -> list[tuple[list[int], int]]:
        """Ids, and the offset at which the last token ends (0 for none)."""
        got = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [(e.ids, e.token_to_chars(len(e) - 1)[1] if len(e) else 0) for e in got]

    def encode_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids with the span of characters that each token touches."""
        return [(e.ids, e.offsets) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        text = "".join(map(self.shown.__getitem__, ids))
        return self.byte_of[np.frombuffer(text.encode("utf-16-le"), dtype=np.uint16)].tobytes()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@functools.cache
def load(path: str, pattern: str) -> ByteBPE:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    return ByteBPE(path, pattern)


class Words:
    """Encodings of words with the spaces before them, for patterns of which no match goes on from a non-space to a space or from
    letters to punctuation (but an apostrophe).

    New words are joined to texts for the library and told apart by their tokens' offsets; the few that do not begin with a space, or
    end with one, are texts of their own. Words are kept in two generations of about ``room`` bytes: one that is full becomes
    the one before, and of that the words which do not occur again are forgotten.
    """

    def __init__(self, bpe: ByteBPE, room: int = 25_000_000):
        self.bpe, self.room, self.held = bpe, room, 0
        self.known: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.behind: dict[str, int] = {}  # characters behind the last token, where there are any
        self.decimals = [str(k) for k in range(max(bpe.shown) + 1)]

    def encode_ends(self, texts: list[str]) -> list[tuple[str, int]]:
        """Ids in decimals with commas, and the offset at which the last token ends (0 for none)."""
        rows = [WORDS.findall(t) for t in texts]
        if self.held > self.room:
            self.before = self.known if self.held < 2 * self.room else {}  # a huge text is not held
            self.known, self.held = {}, 0
        new = []
        for w in set().union(*rows).difference(self.known):
            ids = self.before.get(w)
            if ids is None:
                new.append(w)
            else:
                self._keep(w, ids)
        self._add(new)
        return [(",".join(map(self.known.__getitem__, r)), len(t) - self.behind.get(r[-1], 0) if r else 0) for t, r in zip(texts, rows, strict=True)]

    def _add(self, new: list[str], at_once: int = 100) -> None:
        inner = [w for w in new if w[0] in SPACES and w[-1] not in SPACES]
        groups = [inner[k : k + at_once] for k in range(0, len(inner), at_once)]
        groups += [[w] for w in new if w[0] not in SPACES or w[-1] in SPACES]
        for words, (ids, spans) in zip(groups, self.bpe.encode_offsets(["".join(g) for g in groups]), strict=True):
            shown = list(map(self.decimals.__getitem__, ids))
            ends = list(accumulate(map(len, words)))
            past = np.searchsorted(np.array([a for a, _ in spans]), ends).tolist()
            a = 0
            for w, end, b in zip(words, ends, past, strict=True):
                self._keep(w, ",".join(shown[a:b]))
                if spans[b - 1][1] != end:
                    self.behind[w] = end - spans[b - 1][1]
                a = b

    def _keep(self, word: str, ids: str) -> None:
        self.known[word] = ids
        self.held += len(word) + len(ids) + 150  # two objects and their place


@functools.cache
def load_words(path: str, pattern: str) -> Words:
    return Words(load(path, pattern))


@functools.cache
def load_ids(path: str, pattern: str):
    """An encoder of the same rank file that gives ids alone, several times as fast as the one with offsets."""
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def with_ids(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id, ids``: the ids alone, the same as ``encode`` gives. Null text is empty; a row for each row, whatever its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_ids(path, pattern).encode_ordinary
        for b in _slices(batches):
            rows = [array("i", encode(t)) for t in _texts(b, text)]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(id), lists], ["id", "ids"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id)


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id, ids, starts, ends`` (character spans); null text is empty. Other columns are ignored, repeated rows each
    give a row, an empty table an empty result. A text of any length is one row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in _slices(batches):
            got = bpe.encode_offsets(_texts(b, text))
            cols = [b.column(id), pa.array([x for x, _ in got], pa.list_(pa.int32()))]
            cols += [pa.array([[o[k] for o in spans] for _, spans in got], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "starts", "ends"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(run, f"id {kind}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("id", id)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """``id, text`` from ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(id), pa.array([bpe.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())], ["id", "text"])

    kind = encoded.schema[id].dataType.simpleString()
    return encoded.select(id, ids).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id", by_words: bool = False) -> DataFrame:
    """``id, n_tokens, end_offset, ids_sha256, decoded_sha256``: encode with offsets, decode and digest without shipping the ids.

    ``end_offset`` is where the last token ends: the characters of the text, if its tokens cover it. Null text is empty; repeated rows
    each give a row, an empty table an empty result. Other columns are ignored. ``by_words`` gives the same rows faster for a
    pattern that ``Words`` allows.
    """

    def whole(texts: list[str]) -> list[tuple[str, int]]:
        return [(",".join(map(str, ids)), end) for ids, end in load(path, pattern).encode_ends(texts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        encode = load_words(path, pattern).encode_ends if by_words else whole
        names = ["id", "n_tokens", "end_offset", "ids_sha256", "decoded_sha256"]
        for b in _slices(batches, 64):
            got = encode(_texts(b, text))
            ids = [np.fromstring(shown, dtype=np.int64, sep=",").tolist() if shown else [] for shown, _ in got]
            cols = [
                b.column(id),
                pa.array(map(len, ids), pa.int64()),
                pa.array([end for _, end in got], pa.int64()),
                pa.array([hashlib.sha256(shown.encode()).hexdigest() for shown, _ in got], pa.string()),
                pa.array([hashlib.sha256(bpe.decode_bytes(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(run, f"id {kind}, n_tokens bigint, end_offset bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, by_words=True)
