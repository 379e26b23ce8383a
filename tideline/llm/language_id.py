"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of the hashed 1- to 3-grams are counted over all training documents. The classifier is trained with
follow-the-regularised-leader (per-coordinate rates, elastic-net penalties) on a bounded sample of labelled rows, then a
temperature is fitted on held-out texts of that sample. Prediction is one pass over the text: each character adds its
three n-grams' weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tideline.llm import numtext as nt
from tideline.storage import read_table

FEATURE_BITS = 16
SPACE = 32
#: Brings the inputs of the classifier to the order of 1.
SCALE = 10.0
#: Characters that a task holds as arrays at once (about 75 bytes for each); a longer text is held alone.
AT_ONCE = 1 << 17


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature numbers of the 1-, 2- and 3-grams that end at each character, the bounds of each text and its letters.

    Texts are lower-cased; what isn't a letter counts as a space. A space stands before each text, so that
    n-grams never cross texts; it is part of the text's features, as is a word's start.
    """
    joined = " " + " ".join(t.lower() for t in texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t.lower()) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes  # the first character after each separator
    letter = _letters()[codes]
    c = np.where(letter, codes, SPACE).astype(np.uint64)
    count = np.concatenate([[0], np.cumsum(letter)])
    letters = count[starts + sizes] - count[starts]
    m, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - FEATURE_BITS)
    salt = [np.uint64(k * 0xD1B54A32D192ED03 % (1 << 64)) for k in (1, 2, 3)]
    two, three = c.copy(), c.copy()
    two[1:] += c[:-1] << np.uint64(21)
    three[1:] += c[:-1] << np.uint64(21)
    three[2:] += c[:-2] << np.uint64(42)
    three[starts] = two[starts]  # never look past the separator
    hashed = [((x * m + s) * m >> shift).astype(np.int32) for s, x in zip(salt, (c, two, three), strict=True)]
    return hashed, np.stack([starts, starts + sizes]), letters


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages, already times the inverse document frequency
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str], max_chars: int = AT_ONCE) -> tuple[list[str], np.ndarray]:
        """The most probable language and its calibrated probability; ``und`` and 0 for texts without letters."""
        names, scores, at = [], [], 0
        sizes = np.cumsum([len(t) + 1 for t in texts])
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + max_chars)))
            logits, letters = self._logits(texts[at:stop])
            z = logits / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            names += [self.languages[b] if n else "und" for b, n in zip(best, letters, strict=True)]
            scores.append(np.where(letters > 0, p.max(axis=1), 0.0))
            at = stop
        return names, np.concatenate(scores) if scores else np.zeros(0)

    def _logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hashed, bounds, letters = grams(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for f in hashed:
            for k in range(len(self.languages)):
                run = np.concatenate([[0.0], np.cumsum(self.weights[:, k][f], dtype=np.float64)])
                total[:, k] += run[bounds[1]] - run[bounds[0]]
        return total / np.maximum(bounds[1] - bounds[0], 1)[:, None] + self.bias, letters


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``feature, df`` over all rows; each task sends one row for each feature it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << FEATURE_BITS, dtype=np.int64), 0
        for batch in nt.chunks(batches, text, AT_ONCE):
            hashed, bounds, _ = grams([t or "" for t in batch.column(text).to_pylist()])
            seen = np.zeros(1 << FEATURE_BITS, dtype=bool)
            for a, b in bounds.T:
                seen[:] = False
                for f in hashed:
                    seen[f[a:b]] = True
                df += seen
            n += batch.num_rows
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1), pa.int32()), pa.array(np.append(df[hit], n), pa.int64())], ["feature", "df"])

    return docs.select(text).mapInArrow(run, "feature int, df bigint").groupBy("feature").agg(F.sum("df").alias("df"))


def _sparse(texts: list[str], idf: np.ndarray, max_chars: int = 1 << 20) -> list[tuple[np.ndarray, np.ndarray]]:
    """TF-IDF of each text: term counts over the length, times the inverse document frequency."""
    out = []
    for t in texts:
        hashed, bounds, _ = grams([t])
        f, n = np.unique(np.concatenate([h[bounds[0, 0] : bounds[1, 0]] for h in hashed]), return_counts=True)
        out.append((f, n / max(len(t), 1) * idf[f]))
    return out


def with_pieces(texts: list[str], langs: list[str], seed: int = 11) -> tuple[list[str], list[str]]:
    """The texts and, so that short texts are learned too, a piece of 10 to 120 characters of each."""
    rng = np.random.default_rng(seed)
    pieces = []
    for t in texts:
        size = int(rng.integers(10, 121))
        at = int(rng.integers(0, max(1, len(t) - size)))
        pieces.append(t[at : at + size])
    return [*texts, *pieces], [*langs, *langs]


def split_texts(groups: list[int], seed: int = 7) -> tuple[list[int], list[int]]:
    """Row numbers to fit on, in random order, and those of a fifth of the groups, held out: a text and its piece stay together."""
    rng = np.random.default_rng(seed)
    out = set(rng.permutation(sorted(set(groups)))[::5].tolist())
    order = rng.permutation(len(groups)).tolist()
    return [i for i in order if groups[i] not in out], [i for i in order if groups[i] in out]


def train_ftrl(texts: list[str], langs: list[str], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, epochs: int = 3, groups: list[int] | None = None) -> Model:
    """FTRL-proximal over four fifths of the groups of rows (each row its own by default), the temperature on the rest."""
    names = sorted(set(langs)) or ["und"]
    y = np.array([names.index(v) for v in langs], dtype=np.int64)
    x = _sparse(texts, idf)
    c, size = len(names), len(idf) + 1  # the last feature is the bias
    z, n = np.zeros((size, c)), np.zeros((size, c))

    def weights(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        return np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(n[f])) / alpha + l2))

    fit, held = split_texts(list(range(len(x))) if groups is None else groups)
    for _ in range(epochs):
        for i in fit:
            f, v = np.append(x[i][0], size - 1), np.append(x[i][1], 1.0)
            w = weights(f)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = v[:, None] * p
            root = np.sqrt(n[f])
            n[f] += g * g
            z[f] += g - (np.sqrt(n[f]) - root) / alpha * w
    full = weights(np.arange(size))
    logits = np.array([x[i][1] @ full[x[i][0]] + full[-1] for i in held]).reshape(len(held), c)

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(held)), y[held]] - np.log(np.exp(s).sum(axis=1))).mean())

    grid = np.exp(np.linspace(np.log(0.005), np.log(20), 166))
    temperature = float(min(grid, key=loss)) if held else 1.0
    return Model(names, (full[:-1] * idf[:, None]).astype(np.float32), full[-1], temperature)


def held_out(id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, max_train: int = 4_000, max_chars: int = 20_000) -> Model:
    """Learn from rows with a language and an id that aren't held out.

    Document frequencies are counted over all of them; the classifier is fitted in one task on a sample whose bound is
    documented: at most ``max_train`` rows of at most ``max_chars`` characters, those with the smallest hash of their id (then
    of their text, so that rows which repeat an id are bounded too). Without such rows every text is ``und``.
    """
    train = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    counted = document_frequencies(train).collect()  # at most 2^FEATURE_BITS + 1 rows
    df = np.zeros(1 << FEATURE_BITS)
    total = 0
    for r in counted:
        if r["feature"] < 0:
            total = r["df"]
        else:
            df[r["feature"]] = r["df"]
    idf = SCALE * (np.log((1 + total) / (1 + df)) + 0.1)
    ids = train.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    some = train.where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars).select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")
    sample = some.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "lang").limit(max_train)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((d, t or "", v) for b in batches for d, t, v in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True)))
        if not rows:
            return
        m = train_ftrl(*with_pieces([t for _, t, _ in rows], [v for _, _, v in rows]), idf, groups=[*range(len(rows)), *range(len(rows))])
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.languages], pa.list_(pa.string())), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias.tolist()], pa.list_(pa.float64())), pa.array([m.temperature], pa.float64())],
            ["languages", "weights", "bias", "temperature"],
        )

    got = sample.coalesce(1).mapInArrow(fit, "languages array<string>, weights binary, bias array<double>, temperature double").first()
    if got is None:
        return Model(["und"], np.zeros((1 << FEATURE_BITS, 1), np.float32), np.zeros(1), 1.0)
    names = list(got["languages"])
    return Model(names, np.frombuffer(got["weights"], np.float32).reshape(-1, len(names)).copy(order="F"), np.array(got["bias"]), got["temperature"])


def identify(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, lang_pred, score`` for every row; with ``keep``, those columns of the row in place of ``id``.

    Null, empty and letterless texts are ``und`` with score 0. Of equally probable languages the first by name is
    predicted. Whole texts are read. Repeated rows get a row each; an
    empty table gives an empty result; other columns are ignored. The model, features times languages, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = list(keep or (id,))
    read = list(dict.fromkeys([*kept, text]))
    schema = StructType([*(docs.schema[c] for c in kept), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                names, scores = shared.value.predict([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return docs.select(*read).mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
