"""Edge cases of the text operators: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.llm import chat_format, exact_dedup, jaccard_join, line_dedup, lm_score, packing, quality_rules

SCHEMA = "doc_id long, text string, lang string, id string, digest long, h int, n int, part string, kept string, bucket int, component string, norm string, gone string, label int"
LONG = " ".join(f"w{k % 997}" for k in range(60_000))
BASE = " ".join(f"word{k}" for k in range(120))


def rows():
    texts = [
        (1, "Hello  World\tagain"), (2, "Hello World again"), (3, None), (4, ""), (5, LONG), (6, LONG), (7, BASE), (8, BASE + " tail"), (8, BASE + " tail"),
        (None, "Hello World again"), (None, None), (9, "   "), (10, "a\nsame line here\nb"), (11, "same line here \nSAME LINE HERE\nc"), (12, "é ü　x"), (13, "one"), (14, "one"),
    ]
    return [(d, t, "en", "x", 7, 1, 2, "p", "k", 3, "c", "n", "g", 0) for d, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def test_exact_dedup_edges(docs, none):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows())
    groups = defaultdict(list)
    for d, t, *_ in rows():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = Counter()
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_verifies_bytes_when_digests_collide(docs):
    """With the length as digest, different texts collide; verification must part them."""
    weak = exact_dedup.exact_dedup(docs, digest=lambda c: F.length(c).cast("long"), memtable_rows=2, fan_in=2)
    assert Counter(map(tuple, weak.collect())) == Counter(map(tuple, exact_dedup.exact_dedup(docs).collect()))


def brute_lines(pairs):
    first = {}
    for d, t in pairs:
        for line in (t or "").split("\n"):
            k = line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate({c: c + 32 for c in range(65, 91)})
            first[k] = min(first.get(k, 1 << 63), (1 << 63) - 1 if d is None else d)
    out = []
    for d, t in pairs:
        lines = (t or "").split("\n")
        own = (1 << 63) - 1 if d is None else d
        keep = [x for x in lines if len(k := x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate({c: c + 32 for c in range(65, 91)})) < 10 or first[k] >= own]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return Counter(out)


def test_exact_dedup_filters_let_only_possible_hits_through(spark):
    """Digests that one run alone has are not merged; digests of several runs always are."""
    rows = [(run, 1000 * run + k, run, 1) for run in range(4) for k in range(300)] + [(run, -5, run, 2) for run in range(4)]
    level = spark.createDataFrame(rows, "run long, digest long, keep long, rows long")
    out = {r.digest: (r.keep, r.rows) for r in exact_dedup.merge_level(level, 4, 300 // exact_dedup.BLOCK).collect()}
    assert len(out) == 1201 and out[-5] == (0, 8) and all(v == (d // 1000, 1) for d, v in out.items() if d >= 0)
    own = exact_dedup.filters(level, 300 // exact_dedup.BLOCK)
    assert own.select("run").distinct().count() == 4 and own.count() <= 4 * (300 // exact_dedup.BLOCK)


@pytest.mark.parametrize(("batches", "fan_in"), [(1, 2), (4, 3), (6, 2)])
def test_line_dedup_edges(docs, none, batches, fan_in):
    got = line_dedup.line_dedup(docs, batch_bytes=700_000 // batches, fan_in=fan_in).collect()
    assert Counter(map(tuple, got)) == brute_lines([r[:2] for r in rows()])
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_of_long_texts_takes_linear_time(spark):
    """Every line of a text of 60,000 lines is a copy; with a scan of the dropped hashes per line this takes minutes."""
    text = "\n".join(f"this is line number {k}" for k in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text), (2, text + "\none more line of text"), (3, "this is line number 7\nx")], "doc_id long, text string")
    got = line_dedup.line_dedup(df).collect()
    assert Counter(map(tuple, got)) == brute_lines([(1, text), (2, text), (2, text + "\none more line of text"), (3, "this is line number 7\nx")])


def brute_components(pairs, k, num, den):
    sets = []
    for _, t in pairs:
        w = split_words(t)
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and common * den >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for a, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(a)] = min(least.get(find(a), d), d)
    return Counter((d, len(sets[a]), least.get(find(a)) if sets[a] else d) for a, (d, _) in enumerate(pairs))


@pytest.mark.parametrize("spec", [jaccard_join.Spec(3, 9, 10), jaccard_join.Spec(5, 4, 5, chunk_bytes=2000, range_bytes=50_000), jaccard_join.Spec(1, 1, 2, leaf_sets=1, star_rounds=0)])
def test_jaccard_join_edges(docs, none, spec):
    got = jaccard_join.jaccard_join(docs, spec).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components([r[:2] for r in rows()], spec.k, spec.num, spec.den)
    assert jaccard_join.jaccard_join(none, spec).count() == 0


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_join_equals_brute_force_on_edited_copies(spark, k, num, den):
    """Chains of copies with growing edits, so that many pairs lie just above and below the threshold."""
    pairs = []
    for base in range(4):
        w = [f"b{base}x{i}" for i in range(80 + 30 * base)]
        for edit in range(25):
            copy = list(w)
            for e in range(edit % 13):
                copy[(e * 29 + edit * 7) % len(copy)] = f"edit{edit}y{e % 3}"
            pairs.append((100 * base + edit, " ".join(copy)))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    for spec in (jaccard_join.Spec(k, num, den), jaccard_join.Spec(k, num, den, leaf_sets=1, star_rounds=0), jaccard_join.Spec(k, num, den, leaf_sets=2, star_rounds=1, hubs=1)):
        got = jaccard_join.jaccard_join(df, spec).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(map(tuple, got)) == brute_components(pairs, k, num, den)


def test_signature_trees_lose_no_pair_that_links(spark):
    """One posting with all sets, so that the tree has several levels; each linked pair must be among the leaves' pairs."""
    import numpy as np

    rng = np.random.default_rng(3)
    spec = jaccard_join.Spec(1, 3, 5, leaf_sets=1)
    sets = {}
    for _ in range(60):
        core = rng.choice(3000, 40, replace=False)
        for _ in range(3):
            x = np.unique(np.append(core[rng.random(40) > 0.15], rng.integers(0, 3000, 3)))
            sets[bytes(rng.bytes(16))] = x
    rows = []
    for name, x in sets.items():
        bits = np.zeros(64 * jaccard_join.WORDS, np.uint8)
        bits[x % len(bits)] = 1
        rows.append((bytearray(name), len(x), x.tolist(), np.packbits(bits, bitorder="little").view(np.int64).tolist(), len(x) - int(bits.sum()), len(x) - int(bits.reshape(-1, 64 * jaccard_join.UPPER).max(axis=0).sum())))
    able = spark.createDataFrame(rows, "set_id binary, n bigint, toks array<bigint>, sig array<bigint>, clash bigint, clash_up bigint")
    postings = able.select(F.lit(7).cast("long").alias("key"), "set_id", "n", F.col("set_id").alias("label"))
    left = jaccard_join._traverse(postings, able, None, spec)
    pairs = {(bytes(r.a), bytes(r.b)) for r in left.collect()}
    lower = jaccard_join._traverse(postings, able, None, jaccard_join.Spec(1, 3, 5)).collect()  # one task's tree alone
    assert {(bytes(r.a), bytes(r.b)) for r in lower} == pairs
    linked = {(a, b) for a in sets for b in sets if a < b and 8 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (len(sets[a]) + len(sets[b]))}
    assert linked and linked <= pairs and len(pairs) < len(sets) ** 2 / 8  # most pairs never meet
    links = {(bytes(r.a), bytes(r.b)) for r in jaccard_join._verify(left, able, spec).collect()}
    assert links == linked


def test_quality_statistics_edges(docs, none):
    got = quality_rules.text_stats(docs, keep=("doc_id",)).collect()
    want = Counter()
    for d, t, *_ in rows():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert quality_rules.quality_rules(none, quality_rules.DecisionList()).count() == 0


def test_decision_list_learns_thresholds(spark):
    good = [(k, " ".join(f"w{k}x{i}" for i in range(60 + k % 40))) for k in range(300)]
    bad = [(1000 + k, " ".join(f"W{k}X{i}$$$" for i in range(60 + k % 40))) for k in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good] + [(d, 0, 0) for d, _ in bad] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn_from_labels(docs, labels)
    assert rules.rules and all(len(r) <= 3 for r in rules.rules)
    kept = {r.doc_id for r in quality_rules.quality_rules(docs, rules).where("kept").collect()}
    assert kept == {d for d, _ in good}
    again = quality_rules.learn_from_labels(docs, labels.where("false"))
    assert again.rules == [] and str(again) == "keep all"


def test_grown_rule_has_the_largest_gain_and_a_failed_one_is_set_aside():
    """The learner against plain loops over rows, on two kinds of junk and a deceptive statistic."""
    import math

    import numpy as np

    rng = np.random.default_rng(9)
    names = list(quality_rules.FEATURES)
    for _ in range(5):
        size, edges = 400, 5
        table = {f: rng.integers(-1, edges, size) for f in names}
        p = ((table["symbol_ratio"] >= 3) | ((table["upper_ratio"] >= 2) & (table["bang_ratio"] <= 1)) | (rng.random(size) < 0.02)).astype(np.int64)
        held, n = rng.random(size) < 1 / 3, np.ones(size, dtype=np.int64)
        cuts = {f: [float(k) for k in range(edges)] for f in names}
        grown = quality_rules._grow(table, n, p, ~held, cuts, 1, 4, set())
        rows = [i for i in range(size) if not held[i]]
        prior = math.log2(sum(p[i] for i in rows) / len(rows))
        gains = {}
        for f in names:
            for k in range(edges):
                for above in (True, False):
                    hit = [i for i in rows if (table[f][i] >= k) == above]
                    good = sum(int(p[i]) for i in hit)
                    if good >= 4 and len(hit) < len(rows):
                        gains[f, above, k] = good * (math.log2(good / len(hit)) - prior)
        c = grown[0]
        assert gains[c.feature, c.above, c.cut + 1] == pytest.approx(max(gains.values()))
        rules = quality_rules.cover(table, n, p, held, cuts, 3, 4, 0.9)
        caught = np.zeros(size, dtype=bool)
        for r in rules.rules:
            assert p[held & ~caught & quality_rules._matched(table, r)].mean() >= 0.9
            caught |= quality_rules._matched(table, r)
        assert p[caught].mean() > 0.9 and caught[p == 1].mean() > 0.8
    table = {f: np.zeros(300, dtype=np.int64) for f in names}
    table["digit_ratio"][:90] = 1  # bad rows to grow from, good ones to prune on
    table["bang_ratio"][90:130] = 1
    p, held = np.zeros(300, dtype=np.int64), np.zeros(300, dtype=bool)
    p[:60], p[90:130], held[60:90], held[115:130] = 1, 1, True, True
    rules = quality_rules.cover(table, np.ones(300, dtype=np.int64), p, held, {f: [0.5, 0.7] if f in ("digit_ratio", "bang_ratio") else [] for f in names}, 3, 4, 0.9)
    assert rules.rules and all(c.feature != "digit_ratio" or not c.above for r in rules.rules for c in r[:1])
    assert any(quality_rules._matched(table, r)[90:130].all() for r in rules.rules)


def test_labelled_rows_are_bounded_and_held_out_labels_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.learn_from_labels(docs.where("doc_id % 2 = 0"), labels)
    judged = quality_rules.quality_rules(docs.where("doc_id % 2 = 1"), rules).join(labels, "doc_id").where("not base_failed")
    right = judged.select((F.col("kept") == (F.col("quality") == 1)).cast("int").alias("r")).agg(F.avg("r"), F.count("r")).first()
    assert right[1] > 50 and right[0] > 0.95
    same = spark.createDataFrame([(1, f"w{k} " * 60, "en") for k in range(500)], "doc_id long, text string, lang string")
    assert quality_rules.learn_from_labels(same, spark.createDataFrame([(1, 0)], "doc_id long, quality int"), max_labelled=5).rules == []


def test_packing_bounds_are_optimal():
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 60, 9))
        counts = rng.integers(1, 20, len(lengths))
        for buckets in (1, 2, 3, 5):
            bounds = packing.optimal_bounds(lengths, counts, buckets)

            def cost(bs):
                return sum(c * min(b for b in bs if b >= n) for n, c in zip(lengths, counts, strict=True))

            best = min(cost([*c, lengths[-1]]) for r in range(buckets) for c in itertools.combinations(lengths[:-1], r))
            assert len(bounds) <= buckets and cost(bounds) == best


def test_packing_edges(docs, none):
    got = packing.pack(docs, packing.word_count(), token_budget=200, buckets=4, shard_rows=3).collect()
    assert len(got) == len(rows())
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, len(split_words(t))) for d, t, *_ in rows())
    slots = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.pad_to
        slots[r.bucket, r.pad_to, r.batch].append(r.slot)
    for (_, pad, _), s in slots.items():
        assert sorted(s) == list(range(len(s))) and (len(s) == 1 or len(s) * pad <= 200)
    for bucket in {b for b, _, _ in slots}:  # batches are full but for the last of a bucket
        own = {b: (pad, len(s)) for (k, pad, b), s in slots.items() if k == bucket}
        assert sorted(own) == list(range(len(own)))
        assert all(n == max(1, 200 // max(pad, 1)) for b, (pad, n) in own.items() if b < len(own) - 1)
    assert packing.pack(none, packing.word_count()).count() == 0


def test_bounds_of_many_lengths_equal_the_plain_dynamic_program():
    import numpy as np

    rng = np.random.default_rng(8)
    lengths = np.unique(rng.integers(1, 20_000, 400))
    counts = rng.integers(1, 1000, len(lengths))
    total = np.concatenate([[0], np.cumsum(counts)])
    best = lengths * total[1:]
    for buckets in range(1, 9):
        bounds = packing.optimal_bounds(lengths, counts, buckets)
        cost = sum(int(c) * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts, strict=True))
        assert len(bounds) <= buckets and cost == best[-1]
        best = np.array([min([best[j], *(best[k] + lengths[j] * (total[j + 1] - total[k + 1]) for k in range(j))]) for j in range(len(lengths))])


def test_padded_batches_hold_every_token_id(spark, docs, none):
    got = packing.padded_batches(docs, packing.word_ids(), token_budget=200, buckets=4, shard_rows=3).collect()
    seen = Counter()
    for r in got:
        assert r.n_docs == len(r.doc_ids) == len(r.input_ids) and all(len(x) == r.pad_to for x in r.input_ids)
        assert r.n_docs * r.pad_to <= 200 or r.n_docs == 1
        assert r.n_tokens + r.n_padding == r.n_docs * r.pad_to
        for d, x in zip(r.doc_ids, r.input_ids, strict=True):
            while x and x[-1] == 0:
                x.pop()
            seen[d, tuple(x)] += 1
    ids = docs.select("doc_id", packing.word_ids().alias("t")).collect()
    assert seen == Counter((r.doc_id, tuple(r.t or [])) for r in ids) and sum(len(r.t or []) for r in ids) == sum(r.n_tokens for r in got)
    assert packing.padded_batches(none, packing.word_ids()).count() == 0


def test_packing_takes_ids_of_a_tokenizer(spark):
    P = pytest.importorskip("public_tokenizers")
    from tideline.llm import byte_bpe

    df = spark.createDataFrame([(k, "héllo wörld " * (k % 7)) for k in range(40)], "doc_id long, text string")
    encoded = byte_bpe.encode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    alone = byte_bpe.with_ids(df.unionByName(spark.createDataFrame([(None, None), (99, "")], df.schema)), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = [(r.doc_id, r.ids) for r in encoded.select("doc_id", "ids").collect()]
    assert sorted(((r.doc_id, r.ids) for r in alone.collect()), key=str) == sorted([*want, (None, []), (99, [])], key=str)
    got = packing.padded_batches(encoded, F.col("ids"), pad_id=-1, token_budget=64, buckets=3).collect()
    back = {d: [i for i in x if i >= 0] for r in got for d, x in zip(r.doc_ids, r.input_ids, strict=True)}
    bpe = byte_bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert {d: bpe.decode(x) for d, x in back.items()} == {k: "héllo wörld " * (k % 7) for k in range(40)}


def brute_lm(train, texts):
    """``n_tokens, n_known, N, base, score`` of each text by plain dictionaries."""
    import math

    toks = [[*split_words(t), None] for t in train]
    uni, bi, tri = Counter(), Counter(), Counter()
    for w in toks:
        uni.update(w)
        bi.update(zip([0, *w], w, strict=False))
        tri.update(zip([0, *w], w, w[1:], strict=False))
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda a, w: (bi[a, w] + lm_score.A * p1(w)) / ((uni[a] if a != 0 else len(toks)) + lm_score.A)
    p3 = lambda a, b, w: (tri[a, b, w] + lm_score.B * p2(b, w)) / (bi[a, b] + lm_score.B)
    out = []
    for t in texts:
        w = [*split_words(t), None]
        s = math.log10(p2(0, w[0])) + sum(math.log10(p3(a, b, c)) for a, b, c in zip([0, *w], w, w[1:], strict=False))
        out.append((len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), s))
    for a, b in [(0, "the"), (toks[0][0], toks[0][1] if len(toks[0]) > 1 else "x")] if toks else []:  # the model is normalised
        assert abs(sum(p3(a, b, w) for w in uni) + p3(a, b, "no such word") - 1) < 1e-9
    return out


def same_scores(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    for g, x in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == x[:5]
        assert g[5] == pytest.approx(x[5], rel=1e-9) and abs(g[6] - x[6]) < 5e-4 * x[2]


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 5000, "shard_bytes": 40_000, "hot_share": 0.001}])
def test_lm_score_edges(spark, docs, none, options):
    own = F.coalesce(F.col("doc_id") > 9, F.lit(False))
    model, got = lm_score.train_and_score(docs, own, **options)
    pairs = [(d, t, d is not None and d > 9) for d, t, *_ in rows()]
    want = brute_lm([t for _, t, held in pairs if not held], [t for _, t, _ in pairs])
    same_scores(got.collect(), [(d, held, *x) for (d, _, held), x in zip(pairs, want, strict=True)])
    assert lm_score.lm_score(none, F.lit(False)).count() == 0
    alone = lm_score.lm_score(docs.limit(2), F.lit(True)).collect()  # nothing to learn from
    assert all(r.n_known == 0 and r.score == pytest.approx(r.base_score, rel=1e-5) for r in alone)


def test_lm_saved_model_scores_other_texts(spark, docs):
    from tideline.storage import new_path

    path = new_path(spark, "lm-test")
    lm_score.train_and_score(docs, F.lit(False), shard_bytes=40_000, folder=f"{path}/tries")[0].save(path)
    other = [(1, "hello world again and again"), (2, None), (3, "word3 word4 word5 nothing"), (4, "w1 w2 w3 w4 w5"), (4, "w1 w2 w3 w4 w5")]
    got = lm_score.LanguageModel.load(spark, path).score(spark.createDataFrame(other, "doc_id long, text string")).collect()
    want = brute_lm([t for _, t, *_ in rows()], [t for _, t in other])
    assert Counter(r.n_known for r in got) == Counter(x[1] for x in want)
    for g, (d, x) in zip(sorted(got, key=lambda r: r.doc_id), zip([d for d, _ in other], want, strict=True), strict=True):
        assert (g.doc_id, g.n_tokens) == (d, x[0]) and abs(g.base_score - x[3]) < 1e-3 * x[0] and abs(g.score - x[4]) < 1e-3 * x[0]


def test_chat_round_trip_edges(spark):
    nasty = ["<|im_end|>\n", "\\<|im_start|>", "</s>[INST] ok [/INST]", "a\\\\b\\", "<<SYS>>x<</SYS>>", "<|im_start|>assistant\nhi<|im_end|>\n", None, "", "%0A\n"]
    data = [(c, k, r, t, "extra") for c in (1, 2) for k, (r, t) in enumerate(zip(["user", "assistant", "role\n<x>%5B", None, "assistant"] * 2, nasty, strict=False))]
    data += [(3, 0, "user", "same", "e"), (3, 0, "user", "same", "e"), (3, None, "assistant", "last", "e"), (None, 0, "user", "no id", "e")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat_format.parse_chat(chat_format.format_chat(chat_format.canonical_turns(df))).collect()}
    mixed = chat_format.canonical_turns(chat_format.as_layouts(chat_format.nest(df, chunk=2)))
    assert {r.conv_id: r for r in chat_format.parse_chat(chat_format.format_chat(mixed)).collect()} == out
    assert set(out) == {1, 2, 3, None}
    for c, r in out.items():
        mine = sorted(((1 << 62 if k is None else k), role or "", t or "") for cc, k, role, t, _ in data if cc == c)
        assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, a, b in mine]
        assert r.loss_text == "".join(b for _, a, b in mine if a == "assistant")
        assert r.formatted.count("<|im_start|>") == len(mine) == r.formatted.count("<|im_end|>\n")
    assert chat_format.format_chat(chat_format.canonical_turns(df.where("false"))).count() == 0
    with pytest.raises(ValueError):
        chat_format.canonical_turns(df.drop("turn"))


def test_every_layout_is_mapped_and_unknown_ones_keep_their_content(spark):
    pairs = [(k, t, r, f"text {k} {t}") for k in range(60) for t, r in enumerate(["user", "assistant", "user"][: 2 + k % 2])] + [(99, 0, "tool", "x")]
    nested = chat_format.nest(spark.createDataFrame(pairs, "conv_id long, turn long, role string, text string"))
    got = chat_format.canonical_turns(chat_format.as_layouts(nested)).collect()
    assert {r.layout for r in got} == set(chat_format.MAPPINGS)
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == [(a, b) for c, _, a, b in pairs if c == r.conv_id] and r.raw is None
    extra = chat_format.as_layouts(nested).withColumn("source", F.lit("web")).withColumn("meta", F.struct(F.lit(1).alias("k"), F.array(F.lit("t")).alias("tags")))
    again = {r.conv_id: (r.layout, r.turns) for r in chat_format.canonical_turns(extra).collect()}
    assert again == {r.conv_id: (r.layout, r.turns) for r in got}
    odd = chat_format.canonical_turns(spark.createDataFrame([(1, "q", None), (2, None, None), (3, "q", "a")], "conv_id long, question string, answer string")).collect()
    assert [(r.layout, r.turns is None, r.raw) for r in odd] == [(None, True, '{"conv_id":1,"question":"q"}'), (None, True, '{"conv_id":2}'), ("question_answer", False, None)]


def test_long_conversation_takes_linear_time(spark):
    """32,000 turns in one conversation; with offsets into the whole output this takes minutes."""
    df = spark.range(32_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("said "), F.col("id").cast("string")).alias("text"))
    r = chat_format.parse_chat(chat_format.format_chat(chat_format.canonical_turns(df))).first()
    assert len(r.turns) == 32_000 and r.loss_text == "".join(f"said {k}" for k in range(1, 32_000, 2))


def test_json_layouts_by_fingerprint(spark):
    j = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}],"id":7}'), (2, '{"response":"b","prompt":"a"}'),
        (3, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"z"}]}'), (4, '{"instruction":"i","input":"x","output":"o"}'),
        (5, "nope"), (6, None), (7, '{"question":"i","answer":"o"}'), (8, '{"other":1}'),
    ]
    got = {}
    for r in chat_format.turns_from_json(spark.createDataFrame(j, "id long, j string"), "j", "id").collect():
        got[r.conv_id] = (r.layout, [tuple(t) for t in r.turns or []], r.raw)
    assert got[1] == ("messages", [("user", "hi"), ("assistant", "yo")], None) and got[2][0] == "prompt_response" and got[2][1][1] == ("assistant", "b")
    assert got[3] == ("from_value", [("user", "q"), ("assistant", "z")], None) and got[4][1][0][1] == "i\n\nx"
    assert all(got[k] == (None, [], j[k - 1][1]) for k in (5, 6, 8)) and got[7][1][1] == ("assistant", "o")
