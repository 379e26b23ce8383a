"""Quality rules: a learned decision list over text statistics.

Sequential covering on labelled rows. Each round *grows* a conjunction of thresholds by the best FOIL gain on a growing
set, *prunes* its last conditions on a held-out set, keeps it if it is precise there, and removes the rows it covers. The
first condition of a rule that is not precise is set aside (that statistic on that side of a threshold starts no rule again),
and rounds go on until no rule can be grown. One Spark aggregate counts the labelled rows by class and binned
statistics; that table, bounded by the documented size of the sample, is what the rounds read. The list becomes one
ordered ``CASE WHEN`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import WS, let, words
from tideline.storage import materialise, read_table

#: Statistics that rules may test; all are ratios or counts of one text.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "bang_ratio": "n_bangs / greatest(word_chars, 1)",
    "digit_ratio": "n_digits / greatest(word_chars, 1)",
}


def _kept_chars(text: Column, keep: str) -> Column:
    """How many characters of ``text`` lie in the character class ``keep``."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def repeat_words(tokens: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more, the first occurrence included.

    Windows are hashed, sorted with their positions, and the sorted positions of repeated windows add up their cover:
    each adds 3 words, or as many as lie before the next one. n log n in the length of the text.
    """
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(h, i + 1), F.get(h, i + 2)))

    def repeated(s: Column) -> Column:
        same = lambda e, at: F.coalesce(F.get(s, at)["g"] == e["g"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"]))

    def cover(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(let(pairs, repeated), cover))

    return let(let(hashed, windows), count).cast("long")


def text_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the statistics of each text; null text has no words, one empty line."""
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    toks = src.select(*keep, "_t", words(F.col("_t")).alias("_w"))
    lined = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{WS}]"))
    return toks.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", f"[{WS}]+", "")).cast("long").alias("word_chars"),
        _kept_chars(F.col("_t"), "#*$%&|<>").alias("n_symbols"),
        let(lined, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size(F.split("_t", "\n")).cast("long").alias("n_lines"),
        _kept_chars(F.col("_t"), r"\p{Lu}").alias("n_upper"),
        _kept_chars(F.col("_t"), "!").alias("n_bangs"),
        _kept_chars(F.col("_t"), "0-9").alias("n_digits"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    cut: int  # index of the threshold: a bin above ``cut`` lies above the threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def hits(self, bins: dict[str, np.ndarray]) -> np.ndarray:
        return bins[self.feature] > self.cut if self.above else bins[self.feature] <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first that matches rejects, no match keeps."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule(self) -> Column:
        """The number, from 1, of the first rule that matches; 0 for none."""
        out = F.lit(0)
        for k in range(len(self.rules), 0, -1):
            out = F.when(_all(c.column() for c in self.rules[k - 1]), F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if {' and '.join(map(str, r))}" for k, r in enumerate(self.rules, 1)) or "keep all"


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def learn(stats: DataFrame, bad: Column, key: Column, bins: int = 16, max_conditions: int = 3, min_cover: int = 4, min_precision: float = 0.9) -> DecisionList:
    """Grow and prune rules for ``bad`` rows. ``key`` splits the rows, by hash, in two thirds to grow and a third to prune."""
    base = stats.select(bad.cast("int").alias("bad"), (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("held"), *(F.expr(e).alias(f) for f, e in FEATURES.items()))
    marks = [(k + 0.5) / bins for k in range(bins)]
    rows = base.groupBy("bad").agg(*(F.percentile_approx(f, marks, 2000).alias(f) for f in FEATURES)).collect()  # two rows
    seen = {f: sorted({float(x) for r in rows for x in (r[f] or [])}) for f in FEATURES}
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in seen.items()}  # midway: the widest margin to both sides
    counted = base.groupBy("bad", "held", *(_bin(F.col(f), cuts[f]).alias(f) for f in FEATURES)).count().collect()  # at most a row for each labelled row
    table = {c: np.array([r[c] for r in counted], dtype=np.int64) for c in FEATURES}
    held, bad_n = np.array([r["held"] for r in counted], dtype=bool), np.array([r["bad"] * r["count"] for r in counted], dtype=np.int64)
    return cover(table, np.array([r["count"] for r in counted], dtype=np.int64), bad_n, held, cuts, max_conditions, min_cover, min_precision)


def cover(table: dict[str, np.ndarray], n: np.ndarray, p: np.ndarray, held: np.ndarray, cuts: dict[str, list[float]], max_conditions: int, min_cover: int, min_precision: float) -> DecisionList:
    """Sequential covering over binned statistics: ``n`` rows, ``p`` of them bad, for each line of ``table``."""
    out, left, aside = DecisionList(), np.ones(len(n), dtype=bool), set()
    while grown := _grow(table, n, p, left & ~held, cuts, max_conditions, min_cover, aside):
        kept = _prune(table, n, p, left & held, grown, min_precision)
        if kept is None:
            aside.add((grown[0].feature, grown[0].above))
        else:
            out.rules.append(kept)
            left = left & ~_matched(table, kept)
    return out


def _matched(table: dict[str, np.ndarray], rule: list[Condition]) -> np.ndarray:
    hit = np.ones(len(next(iter(table.values()))), dtype=bool)
    for c in rule:
        hit &= c.hits(table)
    return hit


def _bin(value: Column, cuts: list[float]) -> Column:
    """The index of the last cut below ``value``; -1 for none."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: value > t)) - 1 if cuts else F.lit(-1)


def _grow(table, n, p, rows, cuts, max_conditions: int, min_cover: int, aside: set) -> list[Condition]:
    """Conditions one by one, each with the largest FOIL gain (the first of equals in the order of statistics, cuts and sides)."""
    rule: list[Condition] = []
    for _ in range(max_conditions):
        covered = rows & _matched(table, rule)
        p_all, n_all = int(p[covered].sum()), int(n[covered].sum())
        if p_all in (0, n_all):
            break
        best: tuple[float, Condition] | None = None
        for f in FEATURES:
            sums = [np.bincount(table[f][covered] + 1, weights=w[covered], minlength=len(cuts[f]) + 1)[::-1].cumsum()[::-1] for w in (p, n)]
            for k, t in enumerate(cuts[f]):
                p_up, n_up = sums[0][k + 1], sums[1][k + 1]
                for above, p_in, n_in in ((True, p_up, n_up), (False, p_all - p_up, n_all - n_up)):
                    if p_in >= min_cover and n_in < n_all and (rule or (f, above) not in aside):
                        gain = p_in * (math.log2(p_in / n_in) - math.log2(p_all / n_all))
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = gain, Condition(f, above, t, k - 1)
        if best is None:
            break
        rule.append(best[1])
    return rule


def _prune(table, n, p, rows, rule: list[Condition], min_precision: float) -> list[Condition] | None:
    """The prefix of ``rule`` with the highest precision on held-out rows (then the most bad rows, then the shortest), if that is enough."""
    scored = []
    for k in range(1, len(rule) + 1):
        hit = rows & _matched(table, rule[:k])
        if n[hit].sum():
            scored.append((p[hit].sum() / n[hit].sum(), int(p[hit].sum()), k))
    good = [s for s in scored if s[0] >= min_precision]
    return rule[: max(good, key=lambda s: (round(s[0], 3), s[1], -s[2]))[2]] if good else None


def learn_from_labels(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DecisionList:
    """Learn from at most ``max_labelled`` rows whose ids are labelled, those with the smallest hash of their id (then of their
    statistics, so that rows which repeat an id are bounded too): a documented bound on the classifier's sample, and
    of the broadcast. Rows without a label or an id are left out; of several labels the smallest counts."""
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    stats = materialise(text_stats(rows, keep=("doc_id", "quality")), "rule-stats")
    bounded = stats.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64(*stats.columns)).limit(max_labelled)
    return learn(bounded.where(~base_failed()), F.col("quality") == 0, F.col("doc_id"))


def quality_rules(docs: DataFrame, rules: DecisionList, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics of every text, ``base_failed``, ``rule`` (0: none matched) and ``kept``.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged one by one; an empty table
    gives an empty result; a label table without usable rows gives an empty list, which keeps all that the base keeps.
    """
    stats = text_stats(docs, text, keep)
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(rules.rule()))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = quality_rules(docs, learn_from_labels(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
