"""Source audit, hard negatives and license scans against brute force on odd rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import hard_negatives, license_scan, source_audit, terms

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def audit_rows(docs, top=200):
    """The audit of (text, lang, source) rows, carried out term by term."""
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low(text))
        count[lang, source].update(found)
        df[lang].update(set(found))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        mine = sorted(s for g, s in groups if g == lang)
        n = {s: sum(count[lang, s][t] for t in kept) for s in mine}
        every = {t: sum(count[lang, s][t] for s in mine) for t in kept}
        chance = lambda c, total, v=len(kept): 1 + 10**9 * (c + 1) // (total + v)
        p = {s: {t: chance(count[lang, s][t], n[s]) for t in kept} for s in mine}
        q = {t: chance(every[t], sum(every.values())) for t in kept}
        price = lambda a, b: (a - b) * (a - b) // b
        for s in mine:
            pairs = sorted(((-sum(price(p[s][t], p[o][t]) for t in kept), o.encode()) for o in mine if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)}
            more = sorted((-price(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(more[:top], 1)}
    return out


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = np.random.default_rng(4)
    words = ["the", "Größe", "été", "x1y", "alpha", "BETA", "gamma", "ΔELTA", "日本", "of"]
    rows = [(k, " ".join(rng.choice(words, rng.integers(0, 30))), ["en", "fr", None, ""][k % 4], ["a", "b", None, "é", "c"][k % 5], 0) for k in range(60)]
    rows += [(7, "the the of", "en", "a", 0)] * 3 + [(None, None, "en", "new", 0), (90, "", "de", "x", 0), (91, "lonely", "de", "y", 0), (92, "lonely " * 5000 + "the", "en", "b", 0)]
    return rows


def test_source_audit_equals_terms_one_by_one(spark, odd_docs):
    docs = spark.createDataFrame(odd_docs, DOCS).selectExpr("*", "1 as term", "'z' as rank", "2 as n")
    got = {tuple(r) for r in source_audit.source_audit(docs, top_terms=4).collect()}
    assert got == audit_rows([(r[1], r[2], r[3]) for r in odd_docs], 4)
    assert source_audit.source_audit(docs.where("false")).count() == 0
    assert {r.value for r in source_audit.source_audit(docs.where("lang = 'de'")).collect()} == {0}


def test_blocks_and_tiles_give_the_same_tables(spark, odd_docs, monkeypatch):
    """A block of one row with more columns than a tile, flushes after every few entries and short pieces change nothing."""
    docs = spark.createDataFrame(odd_docs, DOCS)
    batches = source_audit.kept_terms(docs).select("lang", "counts").toArrow().to_batches()
    table = lambda: Counter({tuple(r[k] for k in ("lang", "a", "c", "b", "d")): r["n"] for b in source_audit.block_products(iter(batches)) for r in b.to_pylist()})
    want = table()
    monkeypatch.setattr(source_audit, "TILE", 2)
    monkeypatch.setattr(source_audit, "ROWS", 3)
    got = Counter()
    for b in source_audit.block_products(iter(batches)):
        for r in b.to_pylist():
            got[tuple(r[k] for k in ("lang", "a", "c", "b", "d"))] += r["n"]
    assert got == want and sum(want.values()) > 50 and all(k[1] < k[3] for k in want)
    text = "Ab " * 50 + "c" * 40 + " d1"
    whole = [t for part in terms.term_lists(text, terms.byte_table(False)) for t in part]
    monkeypatch.setattr(terms, "PIECE", 16)
    parts = list(terms.term_lists(text, terms.byte_table(False)))
    assert len(parts) > 5 and [t for p in parts for t in p] == whole and list(terms.term_lists(None, terms.byte_table(True))) == []


def mined(rows, anchors, positives=5, negatives=5):
    """Hard negatives of (id, label, vector) rows by all pairs."""
    out = set()
    score = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=False))
    for i, lab, v in rows:
        if i not in anchors:
            continue
        ranked = sorted((-score(v, w), j, other) for j, other, w in rows if j != i)
        for s, j, _ in [r for r in ranked if r[2] == lab][:positives]:
            fits = [(t, k) for t, k, other in ranked if other != lab and -80 * s <= -100 * t <= -100 * s][:negatives]
            out |= {(i, j, n, k, -s, -t) for n, (t, k) in enumerate(fits, 1)}
    return out


@pytest.mark.parametrize("scale,n", [(60, 240), (1 << 29, 40)])
def test_hard_negatives_equal_all_pairs(spark, scale, n):
    rng = np.random.default_rng(n)
    rows = [(k, int(rng.choice([0, 0, 0, 1, 2])), [float(x) for x in rng.integers(-scale, scale, 7 if k % 9 else 5)]) for k in range(n)]
    rows += [(n + k, 1, rows[0][2]) for k in range(7)] + [(n + 20, 5, rows[3][2]), (n + 21, 6, [0.0] * 7), (n + 22, 6, [])]
    bad = [(n + 30, None, [1.0] * 7), (n + 31, 1, None), (n + 32, 1, [1.0, None]), (n + 33, 1, [float("nan")] * 7), (n + 34, 1, [float("inf")] * 7), (None, 1, [99.0 * scale] * 7), (n, 1, rows[0][2])]
    df = spark.createDataFrame([*rows, *bad], "id long, label long, vec array<double>").selectExpr("*", "1 as part", "2 as norm", "3 as wins")
    anchor = F.col("id") % 10 == 0
    got = {tuple(r) for r in hard_negatives.mine(df, anchor).collect()}
    assert got == mined(rows, {r[0] for r in rows if r[0] % 10 == 0}) and len(got) > 30
    assert hard_negatives.mine(df.where("false"), anchor).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0


def test_blocks_of_rows_and_anchors_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, k % 2, [float(x) for x in rng.integers(-50, 50, 12)]) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, label long, vec array<double>")
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    assert {tuple(r) for r in hard_negatives.mine(df, F.col("id") % 10 == 0).collect()} == mined(rows, set(range(0, 120, 10)))


def test_index_leaves_out_what_can_not_reach_the_threshold():
    rng = np.random.default_rng(5)
    rows = np.round(rng.normal(0, 40, (300, 40)) * np.linspace(2, 0.05, 40))
    queries = np.round(rng.normal(0, 40, (20, 40)) * np.linspace(2, 0.05, 40))
    score = queries @ rows.T
    for least in (float("-inf"), 0.0, float(np.quantile(score, 0.9)), float(np.quantile(score, 0.999)), float(score.max()) + 1):
        each = np.full(20, least) - np.arange(20)
        index = hard_negatives.Index(rows, float(np.sqrt((queries**2).sum(axis=1)).max()), float(each.min()))
        i, j, s = index.search(queries, each)
        assert set(zip(i.tolist(), j.tolist(), s.tolist(), strict=True)) == {(a, b, score[a, b]) for a, b in zip(*np.nonzero(score >= each[:, None]), strict=True)}
        if least > 0:
            assert index.posted.mean() < 40  # suffixes without postings
    assert hard_negatives.Index(rows * 1e-3, 1.0, 1e6).search(queries * 1e-3, np.full(20, 1e6))[0].size == 0


def scanned(text, phrases, templates, threshold):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))
    starts = [(k, name) for p, name in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    best, more = 0.0, {name for _, name in starts}
    base = sorted(more)
    for name, body in templates:
        t = re.findall("[a-z0-9\x80-\U0010ffff]+", low(body))
        size = max(8, 1 << (len(t) - 1).bit_length())
        step, width = size // 2, size + size // 2
        need = math.ceil(threshold * len(set(t)) - 1e-9)
        for b in range(-(-max(len(words) - width, 0) // step) + 1):
            n = len(set(words[b * step : b * step + width]) & set(t))
            if n >= need:
                more, best = more | {name}, max(best, n / len(set(t)))
    at = [k for k, _ in starts]
    return len(words), len(starts), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(more)), 1.0 if starts else best


def test_license_scan_equals_every_block(spark):
    rng = np.random.default_rng(9)
    filler = ["the", "of", "software", "license", "under", "public", "mit", "apache", "general", "copy", "work", "2", "café"]
    texts = [None, "", "   ", "MIT", "mit license", "The MIT License; see Apache License, Version 2.0", "general public license " * 3, "mit", "license", "Mit-License mit\nlicense"]
    for _, body in license_scan.TEMPLATES:
        texts += [body, "word " * 13 + body + " more" * 9, body.replace("the", "a").upper(), " ".join(body.split()[::2]), body[: len(body) * 2 // 3]]
    texts += [" ".join(rng.choice(filler, rng.integers(1, 90))) for _ in range(60)] + ["lorem " * 30_000 + license_scan.TEMPLATES[5][1]]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(3, "mit license"), (3, "mit license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _row", "2 as blocks", "3 as labels").repartition(3)
    out, blocks = license_scan.license_scan(docs)
    got = Counter((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in out.collect())
    want = Counter()
    for i, t in rows:
        r = scanned(t, license_scan.PHRASES, license_scan.TEMPLATES, 0.8)
        want[(i, *r[:6], round(r[6], 9))] += 1
    assert got == want
    assert blocks.where("containment < 0.8 or containment > 1").count() == 0 and blocks.count() > 40
    none, empty = license_scan.license_scan(docs.where("false"))
    assert none.count() == 0 and empty.count() == 0
    with pytest.raises(ValueError):
        license_scan.Rules({}, [("x", "y z")] * 10_001, 0.8)


def test_phrases_do_not_reach_over_texts(spark):
    docs = spark.createDataFrame([(1, "all of mit"), (2, "license of all"), (3, "apache"), (4, "license")], "doc_id long, text string").coalesce(1)
    assert license_scan.license_scan(docs)[0].agg(F.sum("n_base")).first()[0] == 0
