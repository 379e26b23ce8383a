"""License scans: an exact set-similarity join of blocks of text with license templates.

A block is a window of consecutive words, half as long again as a template's size class and half a class from the next, so every run
of a template's length lies in a block. A block holds a template when enough of the template's different words are among its own: at least
``threshold`` of them. Words are put in one order for all, rarest first by the documents that hold them, and three filters find
every such block without comparing the others:

* prefix: two sets with ``need`` words in common share one among the first ``size - need + 1`` of either, which are their rarest;
* length: a block with fewer template words than ``need`` is out;
* position: what follows the common prefix word on either side must be enough for the rest.

Tasks cut the blocks and keep those that hold a prefix word of a template of their class, with their template words in order; Spark
joins these with the templates' prefixes and counts the overlap of the pairs that pass the filters. Templates are a parameter of bounded
size; nothing else is sent to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.numtext import chunks
from tideline.llm.terms import byte_table, term_lists
from tideline.storage import materialise, read_table

#: Phrases that give a label wherever they stand.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Opening notices of common licenses, as their publishers word them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Most templates: they go to every task.
MAX_TEMPLATES = 10_000
#: Bytes of text that a task works on at once.
CHUNK = 8 << 20

TABLE = byte_table(digits=True)
ROW = "_row long, id {id}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<struct<size: int, start: long, words: array<int>>>"


def words_of(text: str) -> list[bytes]:
    return [w for part in term_lists(text, TABLE) for w in part]


@dataclass
class Rules:
    """Phrases and templates over one vocabulary; ``rank`` orders its words, rarest first."""

    phrases: dict[str, str]
    templates: list[tuple[str, str]]
    threshold: float
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    rank: np.ndarray | None = None

    def __post_init__(self):
        if len(self.templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        for text in [*self.phrases, *(t for _, t in self.templates)]:
            for w in words_of(text):
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.codes = [[self.vocabulary[w] for w in words_of(t)] for _, t in self.templates]

    def need(self, k: int) -> int:
        """Words of template ``k`` that a block must hold."""
        return math.ceil(self.threshold * len(set(self.codes[k])) - 1e-9)

    def size(self, k: int) -> int:
        """The size class of template ``k``: its number of words, rounded up to a power of two, 8 at least."""
        return max(8, 1 << (len(self.codes[k]) - 1).bit_length())

    def ordered(self, k: int) -> list[int]:
        """The different words of template ``k`` as places in the global order, rarest first."""
        return sorted({int(self.rank[c]) for c in self.codes[k]})

    def prefix(self, k: int) -> list[int]:
        words = self.ordered(k)
        return words[: len(words) - self.need(k) + 1]


def _codes(texts: list[str | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary's code of every word of the texts in a row (-1: not in it), and the texts' numbers of words."""
    parts, sizes = [], np.zeros(len(texts), np.int64)
    get = vocabulary.get
    for k, text in enumerate(texts):
        for words in term_lists(text, TABLE):
            parts.append(np.fromiter((get(w, -1) for w in words), np.int32, len(words)))
            sizes[k] += len(words)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), sizes


def _frequency(rules: Rules):
    """Documents that hold each word of the vocabulary, by chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(rules.vocabulary), np.int64)
        for chunk in chunks(batches, "text", CHUNK):
            codes, sizes = _codes(chunk.column("text").to_pylist(), rules.vocabulary)
            hit = codes >= 0
            owner = np.repeat(np.arange(len(sizes)), sizes)[hit]
            pairs = np.unique(owner * max(1, len(total)) + codes[hit])
            total += np.bincount(pairs % max(1, len(total)), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["code", "n"])

    return count


def order_words(docs: DataFrame, rules: Rules) -> Rules:
    """``rules`` with the global order of its words; a row for each of them comes to the driver."""
    rows = docs.mapInArrow(_frequency(rules), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(rules.vocabulary), np.int64)
    for r in rows:
        n[r.code] = r.n
    rules.rank = np.argsort(np.argsort(n, kind="stable"), kind="stable").astype(np.int64)
    return rules


def _scanner(rules: Rules):
    """Phrases of each text, and the blocks that hold a prefix word of a template of their size class."""
    starts = [[rules.vocabulary[w] for w in words_of(p)] for p in rules.phrases]
    labels = list(rules.phrases.values())
    sizes = sorted({rules.size(k) for k in range(len(rules.templates))})
    of = {s: [k for k in range(len(rules.templates)) if rules.size(k) == s] for s in sizes}
    rare = {s: np.isin(np.arange(len(rules.vocabulary)), sorted({w for k in of[s] for w in rules.prefix(k)})) for s in sizes}
    least = {s: min(rules.need(k) for k in of[s]) for s in sizes}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK):
            codes, n = _codes(chunk.column("text").to_pylist(), rules.vocabulary)
            first = np.concatenate([[0], np.cumsum(n)])
            owner = np.repeat(np.arange(len(n)), n)
            places, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, phrase in enumerate(starts):
                at = np.flatnonzero(codes == phrase[0])
                at = at[at + len(phrase) <= len(codes)]
                for j, word in enumerate(phrase[1:], 1):
                    at = at[codes[at + j] == word]
                at = at[owner[at] == owner[at + len(phrase) - 1]]
                places.append(at)
                kinds.append(np.full(len(at), k))
            place, kind = np.concatenate(places), np.concatenate(kinds)
            doc = owner[place]
            count = np.bincount(doc, minlength=len(n))
            low, high = np.full(len(n), 1 << 62), np.full(len(n), -1)
            np.minimum.at(low, doc, place - first[doc])
            np.maximum.at(high, doc, place - first[doc])
            found: list[list[str]] = [[] for _ in n]
            for d, k in sorted(set(zip(doc.tolist(), kind.tolist(), strict=True))):
                if labels[k] not in found[d]:
                    found[d].append(labels[k])
            none = pa.array(count == 0)
            blocks = _blocks(codes, n, first, owner)
            column = lambda x: pc.if_else(none, None, pa.array(x))
            arrays = [chunk.column("_row"), chunk.column("id"), pa.array(n), pa.array(count), column(low), column(high), pa.array([sorted(x) for x in found], pa.list_(pa.string())), blocks]
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", "id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"])

    def _blocks(codes: np.ndarray, n: np.ndarray, first: np.ndarray, owner: np.ndarray) -> pa.Array:
        kind = pa.list_(pa.struct([("size", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.int32()))]))
        out: list[list] = [[] for _ in n]
        hits = np.flatnonzero(codes >= 0)
        ranks = rules.rank[codes[hits]]
        for size in sizes:
            step, width = size // 2, size + size // 2
            at = hits[rare[size][ranks]]
            d, p = owner[at], at - first[owner[at]]
            last = -(-np.maximum(n[d] - width, 0) // step)  # the number of a text's last block
            keys = set()
            for back in range(width // step + 1):  # the blocks that hold the word
                b = p // step - back
                fit = (b >= 0) & (b <= last) & (p < b * step + width)
                keys.update(zip(d[fit].tolist(), b[fit].tolist(), strict=True))
            for doc, b in sorted(keys):
                begin = int(first[doc]) + b * step
                stop = min(begin + width, int(first[doc + 1]))
                i, j = np.searchsorted(hits, [begin, stop])
                words = np.unique(ranks[i:j])
                if len(words) >= least[size]:
                    out[doc].append({"size": size, "start": b * step, "words": words.tolist()})
        return pa.array(out, kind)

    return scan


def template_prefixes(spark: SparkSession, rules: Rules) -> DataFrame:
    """``size, word, t, at, n, need, words``: the prefix postings of the templates."""
    rows = []
    for k in range(len(rules.templates)):
        words = rules.ordered(k)
        rows += [(rules.size(k), w, k, at, len(words), rules.need(k), words) for at, w in enumerate(rules.prefix(k))]
    return spark.createDataFrame(rows, "size int, word int, t int, at int, n int, need int, words array<int>")


def matching_blocks(scanned: DataFrame, spark: SparkSession, rules: Rules) -> DataFrame:
    """``_row, start, t, overlap, containment``: every block and template that meet the threshold."""
    least = F.create_map(*(F.lit(x) for s in sorted({rules.size(k) for k in range(len(rules.templates))}) for x in (s, min(rules.need(k) for k in range(len(rules.templates)) if rules.size(k) == s))))
    b = scanned.select("_row", F.explode("blocks").alias("b")).select("_row", "b.size", "b.start", F.col("b.words").alias("b_words"))
    b = b.withColumn("b_n", F.size("b_words"))
    prefix = F.slice("b_words", F.lit(1), F.col("b_n") - least[F.col("size")] + 1)
    rows = b.select("*", F.posexplode(prefix).alias("b_at", "word"))
    met = rows.join(template_prefixes(spark, rules), ["size", "word"])
    rest = F.least(F.col("b_n") - F.col("b_at"), F.col("n") - F.col("at"))  # this common word and what follows it
    pairs = met.where((F.col("b_n") >= F.col("need")) & (rest >= F.col("need")))
    first = pairs.groupBy("_row", "size", "start", "t").agg(F.first("b_words").alias("b_words"), F.first("words").alias("words"), F.first("need").alias("need"))
    over = first.withColumn("overlap", F.size(F.array_intersect("b_words", "words"))).where(F.col("overlap") >= F.col("need"))
    return over.select("_row", "start", "t", "overlap", (F.col("overlap") / F.size("words")).alias("containment"))


def license_scan(docs: DataFrame, id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """A row for each row of ``docs``, and the blocks behind its labels.

    The first: ``_row, id, n_words, n_base`` (places of phrases), ``first_word, last_word`` (their smallest and largest start, from 0; null
    without one), ``base_labels, labels`` (sorted, by commas; the second has those of the templates too), ``score`` (1 with a phrase, else the
    largest containment found, else 0). The second: ``_row, start, t, overlap, containment``, ``t`` counting the templates from 0.

    Null text is empty and has no label. Rows that repeat an id are judged each by itself, null ids too. A text with fewer words than a
    block is one block. An empty table gives empty results; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id).alias("id"), F.col(text).alias("text"))
    rules = order_words(rows.select("text"), Rules(phrases, templates, threshold))
    scanned = materialise(rows.mapInArrow(_scanner(rules), ROW.format(id=rows.schema["id"].dataType.simpleString())), "license-blocks")
    blocks = matching_blocks(scanned, docs.sparkSession, rules)
    label = F.get(F.array(*(F.lit(name) for name, _ in templates)), F.col("t"))
    by_row = blocks.groupBy("_row").agg(F.collect_set(label).alias("more"), F.max("containment").alias("best"))
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    joined = scanned.drop("blocks").join(by_row, "_row", "left")
    out = joined.select("_row", "id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
    return out, blocks


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = license_scan(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_WORDS = r"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEXTS = ", ".join("({}, '{}', '{}')".format(k, name, body.replace("'", "''")) for k, (name, body) in enumerate(TEMPLATES))
_LABELS = ", ".join(f"('{p}', '{name}')" for p, name in PHRASES.items())
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(c="coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT r, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
ph AS (SELECT name, string_split(phrase, ' ') AS p FROM (VALUES {_LABELS}) AS v(phrase, name)),
b AS (SELECT d.r, w.pos, ph.name FROM w JOIN ph ON w.word = ph.p[1] JOIN d ON d.r = w.r WHERE d.ws[w.pos + 1 : w.pos + len(ph.p)] = ph.p),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT name, ',' ORDER BY name) AS base_labels FROM b GROUP BY r),
tw AS (SELECT t, name, {_WORDS.format(c="body")} AS ws FROM (VALUES {_TEXTS}) AS v(t, name, body)),
tl AS (SELECT t, name, len(list_distinct(ws)) AS n, ceil(0.8 * len(list_distinct(ws)) - 1e-9) AS need, greatest(8, cast(pow(2, ceil(log2(len(ws)))) AS BIGINT)) AS size, list_distinct(ws) AS ws FROM tw),
te AS (SELECT t, name, n, need, size // 2 AS step, size + size // 2 AS width, unnest(ws) AS word FROM tl),
h AS (SELECT w.r, te.t, te.name, te.n AS size, te.need, w.word, w.pos // step - k.k AS blk FROM w JOIN te ON te.word = w.word CROSS JOIN range(0, 4) k(k)
  WHERE w.pos // step - k.k >= 0 AND w.pos < (w.pos // step - k.k) * step + width AND w.pos // step - k.k <= ceil(greatest(w.n - width, 0) / step)),
f AS (SELECT r, t, name, count(DISTINCT word) / any_value(size) AS containment FROM h GROUP BY r, t, name, blk HAVING count(DISTINCT word) >= any_value(need)),
m AS (SELECT r, list(DISTINCT name) AS more, max(containment) AS best FROM f GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(CASE WHEN base_labels IS NULL THEN [] ELSE string_split(base_labels, ',') END, coalesce(more, [])))), ',') AS labels,
  cast(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base ON base.r = d.r LEFT JOIN m ON m.r = d.r
"""
