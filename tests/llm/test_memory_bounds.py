"""What the functions inside tasks hold at once: numpy's arrays and Python's objects, without Arrow's buffers."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tideline.llm import jaccard_join, language_id
from tideline.llm import numtext as nt


def peak_mb(run) -> float:
    """MB allocated at the highest point of ``run`` above what was there before."""
    run()  # tables that are made once
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def texts(size: int, words: int = 300) -> list[str]:
    rng = np.random.default_rng(5)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 10, 5000)]
    out, total = [], 0
    while total < size:
        out.append(" ".join(vocabulary[k] for k in rng.integers(0, 5000, words)))
        total += len(out[-1]) + 1
    return out


def test_language_prediction_holds_little_at_once():
    rows = texts(2 << 20)
    w = np.asfortranarray(np.random.default_rng(1).normal(size=(1 << language_id.FEATURE_BITS, 4)).astype(np.float32))
    m = language_id.Model(list("abcd"), w, np.zeros(4), 1.0)
    assert peak_mb(lambda: m.predict(rows)) < 25  # 2 MB of text
    names, scores = m.predict(rows)
    one = [m.predict([t]) for t in rows[:50]]
    assert names[:50] == [n[0] for n, _ in one] and np.allclose(scores[:50], [s[0] for _, s in one])


def test_shingle_sets_are_made_piece_by_piece(monkeypatch):
    rows = pa.array([None, *texts(3 << 20), "", "a", "one two three four five six " * 30_000])
    assert peak_mb(lambda: jaccard_join.shingle_sets(rows, 5)) < 75  # 4 MB of text
    got = jaccard_join.shingle_sets(rows[3:], 5)
    monkeypatch.setattr(jaccard_join, "HASH_BYTES", 1 << 30)
    for x, y in zip(got, jaccard_join.shingle_sets(rows[3:], 5), strict=True):
        assert x.dtype == y.dtype and np.array_equal(x, y)


def test_a_hash_range_is_counted_slice_by_slice(monkeypatch):
    rng = np.random.default_rng(2)
    rows, all_of = [], []
    for part in range(4):
        tok = np.sort(rng.integers(1 << 40, 1 << 41, 400_000).astype(np.uint64))
        tok[::5] = (1 << 40) + 7 * np.arange(len(tok[::5]), dtype=np.uint64)  # every part has these
        tok = np.sort(tok)
        own = rng.integers(0, 50, len(tok)).astype(np.uint64)
        all_of.append(tok)
        rows.append({"part": part, "bucket": 3, "toks": nt.pack_sorted(tok), "ords": nt.pack_planes(own)})
    table = pa.Table.from_pylist(rows, jaccard_join._MAPPED)
    count = lambda: jaccard_join._count((pa.scalar(3),), table)
    values, times = np.unique(np.concatenate(all_of), return_counts=True)
    back = {r["part"]: r for r in count().to_pylist()}
    for part, tok in enumerate(all_of):
        df = times[np.searchsorted(values, tok)]
        assert np.array_equal(nt.unpack_sorted(back[part]["toks"]), tok[df > 1])
        assert np.array_equal(nt.unpack_planes(back[part]["dfs"]), df[df > 1])
    whole = count()
    monkeypatch.setattr(jaccard_join, "SLICES", 1)
    assert whole.equals(count())

    for row, tok in zip(rows, all_of, strict=True):  # evenly spread, as hashes are
        tok = np.sort(rng.integers(0, 1 << 48, len(tok)).astype(np.uint64))
        row["toks"] = nt.pack_sorted(tok)
    monkeypatch.undo()
    table = pa.Table.from_pylist(rows, jaccard_join._MAPPED)
    assert peak_mb(count) < 45  # 1.6 million shingles
