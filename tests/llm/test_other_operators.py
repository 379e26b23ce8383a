"""BPE, language ID, WARC, Elias-Fano and the pipeline."""

import gzip
import io
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import byte_bpe, language_id, registry, warc
from tideline.llm.elias_fano import EliasFano, Level, Trie
from tideline.storage import new_path

try:
    import public_tokenizers as P
except ImportError:
    P = None
needs_vocabularies = pytest.mark.skipif(P is None, reason="no vocabulary files")


@needs_vocabularies
def test_bpe_equals_tiktoken():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.load(path, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    rng = np.random.default_rng(2)
    letters = list("abcdeth in on\n é日😀🏽 　.,!#09'")
    texts = ["", " ", "\n\n  a", "é" * 50, "日本語 混在", "👩‍👩‍👧", "<|endoftext|> [INST]", "a" * 3000, "\u0000", "don't I'LL we've", "    \n\n\n   \t  x   "]
    texts += ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(500)]
    for t, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids == ref.encode_ordinary(t)
        assert bpe.decode(ids) == t and bpe.decode_bytes(ids) == t.encode() == b"".join(map(ref.decode_single_token_bytes, ids))
    for t, (ids, spans), (same, end) in zip(texts, bpe.encode_offsets(texts), bpe.encode_ends(texts), strict=True):
        assert ids == same == ref.encode_ordinary(t) and end == len(t) and len(spans) == len(ids)
        cover = sorted({k for a, b in spans for k in range(a, b)})
        assert cover == list(range(len(t)))
    assert bpe.decode(bpe.encode(["😀"])[0][:1]) == "\ufffd"  # a part of a character
    ids, spans = bpe.encode_offsets(["né 😀"])[0]
    assert spans[0][0] == 0 and spans[-1][1] == 4 and len(ids) == len(spans)


@needs_vocabularies
def test_bpe_frames(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame([(1, "héllo 😀", "c"), (2, None, "c"), (3, "", "c"), (3, "", "c"), (None, "x" * 100_000, "c")], "doc_id long, text string, ids string")
    enc = byte_bpe.encode(df, path, P.PATTERN)
    dec = sorted(((r.doc_id or 0), r.text) for r in byte_bpe.decode(enc, path, P.PATTERN).collect())
    assert dec == [(0, "x" * 100_000), (1, "héllo 😀"), (2, ""), (3, ""), (3, "")]
    assert byte_bpe.round_trip(df.where("false"), path, P.PATTERN).count() == 0
    assert sorted(r.end_offset for r in byte_bpe.round_trip(df, path, P.PATTERN).collect()) == [0, 0, 0, 7, 100_000]


@needs_vocabularies
@pytest.mark.parametrize("room", [0, 100_000, 25_000_000])
def test_bpe_by_words_equals_tiktoken(spark, room):
    """Words are encoded once, and alike in every text: every kind of space, contractions, letters beside punctuation, forgotten words."""
    import hashlib

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ref, bpe = byte_bpe.load_ids(path, P.PATTERN), byte_bpe.load(path, P.PATTERN)
    rng = np.random.default_rng(5)
    letters = [*"abcdeth in on\n é日😀🏽 .,!#09''-(ÿſØ×÷ʼ\u0301\u0558\x1c\x1f\u200b\ufeff\x00", *byte_bpe.SPACES, "'s", "'ll", "don't,", " the", " of,", "\r\n"]
    texts = ["", " ", "\n\n  a", "a  ", "  ", "x" * 5000, "x,'s", "x's, it's.", "-,-a,b", "a" + " " * 300 + "b"]
    texts += ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(1000)]
    words = byte_bpe.Words(bpe, room)
    for _ in range(2):
        for k in range(0, len(texts), 64):
            for t, (shown, end) in zip(texts[k : k + 64], words.encode_ends(texts[k : k + 64]), strict=True):
                assert shown == ",".join(map(str, ref.encode_ordinary(t))) and end == len(t)
    asked = []
    words = byte_bpe.Words(bpe)
    words.bpe = type("Counting", (), {"encode_offsets": lambda self, x: asked.extend(x) or bpe.encode_offsets(x)})()
    words.encode_ends(["a bc bc, bc"] * 50)
    words.encode_ends(["d bc bc, bc"])
    assert "".join(sorted(asked)) == " bc,ad"  # each word went to the library once
    if room:
        return
    df = spark.createDataFrame([*enumerate(texts), (None, None), (5, "x, y")], "doc_id long, text string")
    rows = [Counter(map(tuple, byte_bpe.round_trip(df, path, P.PATTERN, by_words=w).collect())) for w in (False, True)]
    assert rows[0] == rows[1] and rows[0].total() == len(texts) + 2
    assert {r[4] for r in rows[1]} == {hashlib.sha256(t.encode()).hexdigest() for t in [*texts, "x, y"]}
    assert byte_bpe.round_trip(df.where("false"), path, P.PATTERN, by_words=True).count() == 0


def test_language_id_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = registry.queries()["op7_language_id"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_id_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.learn(docs)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !!", 1), (None, "The house of the", 1), (5, "the " * 50_000, 1), (5, "the " * 50_000, 1)], "doc_id long, text string, score int")
    out = {(r.doc_id, r.lang_pred) for r in language_id.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "en")} <= out
    assert all(0 <= r.score <= 1 for r in language_id.identify(odd, model).collect())
    assert language_id.identify(odd.where("false"), model).count() == 0
    empty = language_id.learn(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}


def plain_features(text):
    """Hashed 1- to 3-grams of one text, character by character."""
    m = 0x9E3779B97F4A7C15
    chars = [32, *(ord(c) if c.isalpha() else 32 for c in text.lower())]
    out = []
    for at in range(1, len(chars)):
        for k in (1, 2, 3):
            gram = chars[max(0, at - k + 1) : at + 1]
            x = sum(c << (21 * j) for j, c in enumerate(reversed(gram)))
            out.append((((x * m + k * 0xD1B54A32D192ED03) * m) % (1 << 64)) >> (64 - language_id.FEATURE_BITS))
    return out


def test_language_prediction_equals_brute_force():
    rng = np.random.default_rng(6)
    w = rng.normal(size=(1 << language_id.FEATURE_BITS, 3)).astype(np.float32)
    m = language_id.Model(["a", "b", "c"], np.asfortranarray(w), np.array([0.1, 0.0, -0.1]), 0.7)
    texts = ["Hello, wörld!", "x", "", "12 3", "Ça va   bien", "ab" * 500, "日本 語", "a"]
    names, scores = m.predict(texts, max_chars=40)
    for t, name, score in zip(texts, names, scores, strict=True):
        if not any(c.isalpha() for c in t):
            assert (name, score) == ("und", 0)
            continue
        z = (sum(w[f].astype(float) for f in plain_features(t)) / len(t) + m.bias) / m.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert name == "abc"[int(p.argmax())] and abs(score - p.max()) < 1e-6


def test_equal_languages_give_the_first_by_name():
    m = language_id.Model(["a", "b"], np.zeros((1 << language_id.FEATURE_BITS, 2), np.float32), np.zeros(2), 1.0)
    assert m.predict(["some text"])[0] == ["a"] and m.predict(["some text"])[1][0] == 0.5


def test_ftrl_equals_brute_force():
    """The same updates by plain dictionaries, in the same order."""
    import math

    texts, langs = ["aba ab", "cdc d", "abab", "dcdc cc", "bab a", "ddc"], ["x", "y", "x", "y", "x", "y"]
    idf = np.linspace(1, 3, 1 << language_id.FEATURE_BITS)
    alpha, beta, l1, l2 = 0.5, 1.0, 1e-3, 1e-4
    m = language_id.train_ftrl(texts, langs, idf, alpha, beta, l1, l2, epochs=2)
    z, n = {}, {}
    weight = lambda f, k: 0.0 if abs(z.get((f, k), 0.0)) <= l1 else -(z[f, k] - math.copysign(l1, z[f, k])) / ((beta + math.sqrt(n[f, k])) / alpha + l2)
    for _ in range(2):
        for i in language_id.split_texts(list(range(6)))[0]:
            feats = plain_features(texts[i])
            x = {f: feats.count(f) / len(texts[i]) * idf[f] for f in set(feats)} | {"bias": 1.0}
            w = {(f, k): weight(f, k) for f in x for k in (0, 1)}
            s = [sum(x[f] * w[f, k] for f in x) for k in (0, 1)]
            p = [math.exp(v - max(s)) for v in s]
            for k in (0, 1):
                err = p[k] / sum(p) - (langs[i] == "xy"[k])
                for f in x:
                    g = err * x[f]
                    old = n.get((f, k), 0.0)
                    n[f, k] = old + g * g
                    z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(n[f, k]) - math.sqrt(old)) / alpha * w[f, k]
    for f in {f for f, _ in z if f != "bias"}:
        assert m.weights[f] == pytest.approx([weight(f, k) * idf[f] for k in (0, 1)], abs=1e-5)
    assert m.bias == pytest.approx([weight("bias", k) for k in (0, 1)], abs=1e-9)


def test_pieces_stay_with_their_text_and_repeated_ids_are_bounded(spark):
    groups = [*range(50), *range(50)]
    fit, held = language_id.split_texts(groups)
    assert sorted([*fit, *held]) == list(range(100)) and not {groups[i] for i in fit} & {groups[i] for i in held} and len(held) == 20
    seen = []
    original = language_id.train_ftrl
    rows = [(7 if k < 300 else k, f"word{k} text", "en" if k % 2 else "de") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some = language_id.learn(df, max_train=20)
    assert some.languages == ["de", "en"] and original is language_id.train_ftrl and not seen
    assert language_id.learn(df, max_train=20, max_chars=1).languages == ["und"]


def test_ftrl_recovers_classes():
    texts = [("aba " if k % 2 else "cdc ") * (1 + k % 5) for k in range(200)]
    idf = np.ones(1 << language_id.FEATURE_BITS) * language_id.SCALE
    m = language_id.train_ftrl(texts, ["x" if k % 2 else "y" for k in range(200)], idf)
    assert m.predict(["aba", "cdc cdc", "..."])[0] == ["x", "y", "und"]


def test_warc_round_trip_edges(spark):
    big = "<p>" + "é" * 800
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, None), (4, "http://c\r\nX: y", "small"), (5, "u", "small"), (5, "u", "small"), (None, "n", big), (7, "u", "y" * 2_000_000), (2, "http://b", big)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = new_path(spark, "warc-test")
    manifest = warc.write_warc(df, path, archive_bytes=1500)
    for got in (warc.read_archives(manifest), warc.read_warc(spark, path)):
        out = sorted(got.collect(), key=lambda r: (r.page_id is not None, r.page_id or 0))
        assert len(out) == len(rows) and all(r.verified for r in out)
        kinds = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in out]
        n = len(big.encode())
        assert kinds == [(None, "revisit", 2, n), (1, "revisit", 2, n), (2, "response", None, n), (2, "response", None, n), (3, "response", None, 0), (4, "response", None, 5), (5, "response", None, 5), (5, "response", None, 5), (7, "response", None, 2_000_000)]
        assert next(r for r in out if r.page_id == 7).payload == b"y" * 2_000_000
    assert warc.read_archives(warc.write_warc(df.where("false"), new_path(spark, "warc-test"))).count() == 0


def test_warc_reader_is_sequential_and_strict():
    data = b"".join(gzip.compress(warc.record(k, "u", b"z" * k, None, False, "2024-01-01T00:00:00Z")) for k in range(50))
    blocks = lambda size: iter(lambda f=io.BytesIO(data): f.read(size), b"")
    for size in (1, 7, 4096, len(data)):
        got = list(warc.read_records(blocks(size)))
        assert [r["page_id"] for r in got] == list(range(50)) and [r["payload"] for r in got] == [b"z" * k for k in range(50)]
        assert [(r["payload"], r["payload_bytes"]) for r in warc.read_records(blocks(size), keep_payload=False)] == [(None, k) for k in range(50)]
    with pytest.raises(EOFError):
        list(warc.read_records([data[:-3]]))
    with pytest.raises(zlib.error):
        list(warc.read_records([b"not gzip"]))
    for broken in (warc.record(1, "u", b"abc", None, False, "d")[:-6], warc.record(1, "u", b"abc", None, False, "d") + b"x", b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.read_records([gzip.compress(broken)]))
    bad = gzip.compress(warc.record(1, "u", b"abc", None, False, "d").replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        list(warc.read_records([bad]))
    assert [r["verified"] for r in warc.read_records([bad], strict=False)] == [False]


def test_warc_reader_holds_a_block_at_a_time():
    """A record of 64 MB that compresses to almost nothing is read in bounded pieces."""
    import tracemalloc

    data = gzip.compress(warc.record(1, "u", b"y" * (64 << 20), None, False, "d"))
    tracemalloc.start()
    assert [r["payload_bytes"] for r in warc.read_records([data], keep_payload=False)] == [64 << 20]
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()


def test_elias_fano_equals_arrays():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000, 20_000):
        for top in (1, 100, 1 << 20, 1 << 48):
            v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
            e = EliasFano.build(v)
            if n:
                assert (e.values() == v).all() and (e.get(np.arange(n)) == v).all()
            q = np.concatenate([v[:300], rng.integers(0, top, 300, dtype=np.uint64)])
            at, hit = e.find(q)
            assert (hit == np.isin(q, v)).all() and (v[at[hit]] == q[hit]).all()


def test_trie_searches_inside_the_contexts_range(tmp_path):
    rng = np.random.default_rng(4)
    levels, truth = [], []
    for size in (300, 40, 1):
        pairs = np.unique(rng.integers(0, size, (4000, 2)), axis=0).astype(np.uint64)
        ctx, succ = pairs[:, 0] * np.uint64(7919), pairs[:, 1] << np.uint64(20)
        value = rng.random(len(pairs)) * 9
        levels.append(Level.build(ctx, succ, value))
        truth.append((ctx, succ, value))
    (tmp_path / "t.ef").write_bytes(Trie([*levels, Level.build(ctx[:0], succ[:0], value[:0])]).dump())
    trie = Trie.map(np.memmap(tmp_path / "t.ef", dtype=np.uint8, mode="r"))
    for level, (ctx, succ, value) in zip(trie.levels, truth, strict=False):
        assert np.abs(level.lookup(ctx, succ) - value).max() < 2e-4
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        assert (level.pointers.values() == np.append(first, len(ctx)).astype(np.uint64)).all()
        low, high, _ = level.ranges(ctx[first])
        assert (low == first).all() and (high == np.append(first[1:], len(ctx))).all()
        assert (level.lookup(ctx, succ + np.uint64(1 << 19)) == -1).all()
        assert (level.lookup(ctx + np.uint64(1), succ) == -1).all()
        shuffled = np.sort(rng.integers(0, 1 << 30, 50).astype(np.uint64))
        assert (level.lookup(np.full(50, ctx[0]), shuffled) == -1).all()
        broken = Level(level.contexts, EliasFano.build(np.zeros(level.pointers.n, np.uint64)), level.successors, level.codes)
        assert (broken.lookup(ctx, succ) == -1).all()  # the pointers are what bounds the search
    assert (trie.levels[3].lookup(ctx, succ) == -1).all()


def test_pipeline_equals_its_parts(spark, sf_dir):
    """Clean documents stay, every stage's decision takes effect, and one document of each group is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns
        kept = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    ids = {r.doc_id for r in kept.collect()}
    of = lambda df: sorted(r.doc_id for r in df.collect())
    assert of(packed) == sorted(ids) == of(corpus_pipeline.run(spark, sf_dir))
    assert packed.agg(F.min("n_tokens")).first()[0] >= 50  # tokens, of texts of 50 words or more
    assert 0.6 * docs.count() < len(ids) < docs.count()


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and n_chars > 2000").first().text
    odd = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " ", None, None, None), (3, None, "en", "s", 0), (None, text, "en", "s", 1)], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        if name == "exact_dedup":  # one row of each text: the trailing space makes text 2 another one
            assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3]
        assert stage(spark, odd.where("false"), sf_dir).count() == 0
        clashing = odd.selectExpr("*", "1 as row", "2 as tokens", "'x' as batch", "3 as h")
        assert stage(spark, clashing, sf_dir).count() > 0


def test_pipeline_judges_rows_when_ids_repeat_or_are_null(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    a, b, c, d = (" ".join(f"{w}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)) for w in ("alpha", "bravo", "carol", "delta"))
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], schema)
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    want = lambda rows: sorted(rows, key=str)

    rows = [(5, a), (5, b), (3, b), (None, c), (None, b), (None, d), (None, d), (7, a), (7, a)]
    assert left(corpus_pipeline.exact(spark, table(rows), sf_dir)) == want([(5, a), (3, b), (None, c), (None, d)])

    rows = [(5, a), (5, b), (3, b + " end"), (None, c), (None, b + " stop"), (None, d), (None, d + " end"), (7, a + " end"), (7, a + " end"), (8, ""), (8, None)]
    got = left(corpus_pipeline.near(spark, table(rows), sf_dir))
    assert len(got) == 6 and [r for r in got if r[1] not in (d, d + " end")] == want([(5, a), (3, b + " end"), (None, c), (8, ""), (8, None)])
    assert got == left(corpus_pipeline.near(spark, table(rows).repartition(5, "text"), sf_dir))

    rows = [*((i, a) for i in range(12)), (5, "12345 !!"), (None, b), (None, None), (None, "")]
    assert left(corpus_pipeline.language(spark, table(rows), sf_dir)) == want([*((i, a) for i in range(12)), (None, b)])
