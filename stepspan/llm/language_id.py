"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, runs of anything but letters become one space, and its 1- to 3-grams are hashed into 2**BITS
features. Inverse document frequencies cover every training document. The regression is fitted with the
follow-the-regularised-leader-proximal rule, one example at a time, with elastic-net penalties (L1 makes it sparse) on a
bounded sample, SAMPLE documents in all, evenly per language; a fifth of the sample sets the temperature of the softmax.
The LANGS most common languages are learned at most (ties by name); equal scores go to the first by name.

Training documents have a non-null lang and crc32(doc_id as text) mod 5 other than 0; lang, source and doc_id never enter
a prediction. Nulls and edges: a null text, or one without a letter, is "und" with score 0, as is every text when there
is nothing to learn from. A null doc_id counts as held out. Repeated rows are predicted alike. Long texts are taken whole,
in pieces of a bounded size. Only doc_id, text and lang are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BITS, ORDERS = 16, 3
#: Training documents in the sample, in all languages together.
SAMPLE = 2000
#: Languages learned at most: the weights are 2**BITS numbers each.
LANGS = 200
#: Code points of a text looked at together.
PIECE = 500_000

_MIX = (2654435761, 2246822519, 3266489917)


class Grams:
    """A text to the counts of its features; None if it has no letter."""

    def __init__(self) -> None:
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str | None) -> np.ndarray | None:
        counts, before = np.zeros(1 << BITS, np.int64), np.array([32], np.uint32)
        found = False
        for at in range(0, len(text or ""), PIECE):
            code = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            is_letter = self.letter[code]
            found = found or bool(is_letter.any())
            code = np.where(is_letter, code, np.uint32(32))
            code = np.concatenate([before, code])
            fresh = len(before)
            keep = np.ones(len(code), bool)
            keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
            keep[:fresh] = True
            code = code[keep]
            h = np.zeros(len(code), np.uint32)
            for n in range(1, ORDERS + 1):
                h = code if n == 1 else h[:-1] * np.uint32(0x01000193) ^ code[n - 1 :]
                last = h[max(fresh - n + 1, 0) :]  # those that end among the new code points
                counts += np.bincount((last * np.uint32(_MIX[n - 1])) >> np.uint32(32 - BITS), minlength=1 << BITS)
            before = code[-(ORDERS - 1) :]
        return counts if found else None


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[features]
        return x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def scores(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(features, counts) @ self.weights[features] + self.weights[-1]

    def predict(self, counts: np.ndarray | None) -> tuple[str, float]:
        if counts is None or not self.langs:
            return "und", 0.0
        features = np.flatnonzero(counts)
        s = self.scores(features, counts[features]) / self.temperature
        p = np.exp(s - s.max())
        return self.langs[int(p.argmax())], float(p.max() / p.sum())


def fit_ftrl(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> None:
    """FTRL-proximal over rows of (label, features, counts), in order; sets model.weights (the last row: the bias)."""
    size, k = 1 << BITS, len(model.langs)
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    model.weights = np.zeros((size + 1, k))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for label, features, counts in rows:
            at = np.append(features, size)
            x = np.append(model.vector(features, counts), 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    model.weights = weights(z, n)


def fit_temperature(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """The temperature of least log loss on rows kept out of the fit, by golden section over its logarithm."""
    if not rows:
        return
    s = np.stack([model.scores(f, c) for _, f, c in rows])
    y = np.array([label for label, _, _ in rows])

    def loss(log_t: float) -> float:
        t = s / np.exp(log_t)
        top = t.max(1, keepdims=True)
        return float((np.log(np.exp(t - top).sum(1)) + top[:, 0] - t[np.arange(len(y)), y]).mean())

    lo, hi, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    model.temperature = float(np.exp((lo + hi) / 2))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n): documents of this task with the feature; feature -1: all documents."""
    grams, df, docs = Grams(), np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            for text in batch.column(0).slice(i, 128).to_pylist():
                docs += 1
                if (counts := grams(text)) is not None:
                    df += counts > 0
    some = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(df[some], docs), pa.int64())], names=["feature", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            got = [c if (c := grams(t)) is not None else np.zeros(1 << BITS, np.int64) for t in part.column(2).to_pylist()]
            features = [np.flatnonzero(c).astype(np.int32) for c in got]
            counts = [c[f].astype(np.int32) for c, f in zip(got, features, strict=True)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(features, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["h", "lang", "features", "counts"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Document frequencies (2**BITS numbers) and the features of the sample come to the driver, no texts."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull())
    per_lang = {r[0]: r[1] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    langs = sorted(per_lang)
    size = 1 << BITS
    model = Model(langs, np.ones(size), np.zeros((size + 1, len(langs))), 1.0)
    if not langs:
        return model
    df, n = np.zeros(size), 0
    for feature, k in known.select("text").mapInArrow(_frequencies, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n")).collect():
        if feature < 0:
            n = k
        else:
            df[feature] = k
    model.idf = np.log((1 + n) / (1 + df)) + 1
    share = F.lit(0.0)
    for lang, k in per_lang.items():
        share = F.when(F.col("lang") == lang, sample / len(langs) / k).otherwise(share)
    h = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    chosen = known.filter(h < share * (1 << 30)).select(F.xxhash64("doc_id", "text").alias("h"), "lang", "text")  # one order for all reruns
    got = chosen.mapInArrow(_sparse, "h bigint, lang string, features array<int>, counts array<int>").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    place = {lang: i for i, lang in enumerate(langs)}
    rows = [(place[lang.as_py()], np.asarray(f.values, np.int64), np.asarray(c.values, np.float64)) for lang, f, c in zip(got["lang"], got["features"], got["counts"], strict=True) if len(f.values)]
    fit_ftrl(model, [r for i, r in enumerate(rows) if i % 5])
    fit_temperature(model, rows[::5])
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row a document."""
    spark = docs.sparkSession
    small_batches(spark)
    model = model or train(docs)
    shared = spark.sparkContext.broadcast((model.langs, model.idf, model.weights, model.temperature))  # 2**BITS x languages numbers
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, known = Grams(), Model(*shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                got = [known.predict(grams(t)) for t in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
