"""Vectorised word hashing over Arrow string columns, for tasks of the operators that run numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)  # a fixed random value for each byte
_BASE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Word hashes of several texts in a row; ``first[d]`` and ``first[d + 1]`` bound text ``d``."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def hash_words(texts: pa.Array) -> Words:
    """64-bit hashes of the words of each text, A-Z lower-cased, split at ASCII white space; null has none.

    Takes about 25 bytes of memory for each byte of text; the texts together must stay below 2 GB.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return Words(np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64))
    ink = ~_WS[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(ink & (np.concatenate([[True], ~ink[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(ink & (np.concatenate([~ink[1:], [True]]) | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.zeros(0, U64), first)
    sizes = ends - starts
    begin = np.zeros(len(data), dtype=np.int32)
    begin[starts] = starts
    np.maximum.accumulate(begin, out=begin)
    at = np.arange(len(data), dtype=np.int32)
    at -= begin
    del begin
    at[~ink] = 0
    value = _TABLE[_LOWER[data]]
    value *= powers(int(sizes.max()))[at]
    del at
    value[~ink] = 0
    return Words(mix(np.add.reduceat(value, starts) + sizes.astype(U64)), first)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, hash)`` of every window of ``k`` words; a text with fewer words gives its whole sequence as one."""
    h, owner, counts = words.hashes, words.owner(), words.counts
    odd = powers(k + 2)[1:] | U64(1)
    n = len(h) - k + 1
    if n > 0:
        whole = owner[:n] == owner[k - 1 :]
        total = np.zeros(n, dtype=U64)
        for j in range(k):
            total += h[j : j + n] * odd[j]
        own, got = owner[:n][whole], mix(total[whole])
    else:
        own, got = np.zeros(0, np.int64), np.zeros(0, U64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), dtype=U64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] += h[words.first[short[has]] + j] * odd[j]
        extra = mix(extra + counts[short].astype(U64) * U64(0xD6E8FEB86659FD93))
        own, got = np.concatenate([own, short]), np.concatenate([got, extra])
    return own, got


def chunks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int, max_rows: int = 30_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, joined or cut to about ``max_bytes`` of text; a longer text is a chunk of its own."""
    held, size, rows = [], 0, 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, base + max_bytes - size, side="right"))
            stop = min(stop, at + max_rows - rows, batch.num_rows)
            if stop <= at:
                if held:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size, rows = [], 0, 0
                    continue
                stop = at + 1
            held.append(batch.slice(at, stop - at))
            size, rows, at = size + int(ends[stop - 1] - base), rows + stop - at, stop
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted integers as compressed byte planes of their differences."""
    diff = np.diff(values.astype(U64), prepend=U64(0))
    return pack_planes(diff)


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(blob), dtype=U64)


def pack_planes(values: np.ndarray) -> bytes:
    """Integers as zstd-compressed byte planes; planes that are all zero are left out."""
    values = np.ascontiguousarray(values.astype(U64))
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + len(values).to_bytes(6, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_planes(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:7], "little")
    raw = np.frombuffer(pa.decompress(blob[7:], width * n, codec="zstd", asbytes=True), dtype=np.uint8) if n else np.zeros(0, np.uint8)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.reshape(-1).view(U64)


def join_blobs(*blobs: bytes) -> bytes:
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def split_blobs(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        size = int.from_bytes(body[at : at + 8], "little")
        out.append(body[at + 8 : at + 8 + size])
        at += 8 + size
    return out
