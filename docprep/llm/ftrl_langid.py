"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Counts of 1- to 3-grams of characters are hashed to ``DIMENSIONS`` features. IDF counts all
texts that may be learned from. The weights are fitted by follow-the-regularised-leader
(proximal) with elastic-net penalties, one text at a time, in a task of its own on a
bounded sample (``per_language`` ids of each language, the first in an order of hashed
ids; of an id's several rows the text with the smallest hash counts). That task gets the
texts' n-gram counts, at most ``dimensions`` a text however long it is; a temperature fitted on a fifth of the sample calibrates the probabilities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docprep.llm.common import lookup_bounded, materialise

DIMENSIONS = 1 << 14
GRAMS = (1, 2, 3)
PER_LANGUAGE = 1_000
MAX_LANGUAGES = 1_000
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
_PART = 1 << 20  # characters hashed at once
_MULT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def gram_counts(text: str, dimensions: int = DIMENSIONS, grams: tuple = GRAMS) -> np.ndarray:
    """Counts of the hashed character n-grams of a whole text (lower case)."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    total = np.zeros(dimensions, dtype=np.int64)
    shift = np.uint32(32 - (dimensions.bit_length() - 1))
    for n in grams:
        for lo in range(0, max(0, len(c) - n + 1), _PART):
            part = c[lo : lo + _PART + n - 1]
            h = np.full(len(part) - n + 1, n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ part[k : len(part) - n + 1 + k]) * _MULT[k]
                h ^= h >> np.uint32(15)
            total += np.bincount((h * _MULT[0]) >> shift, minlength=dimensions)
    return total


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights): TF-IDF with damped counts, length 1."""
    counts = gram_counts(text, len(idf))
    at = np.flatnonzero(counts)
    return at, _weighted(at, counts[at], idf)


def _weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for all classes at once; weights are exact zeros where |z| <= l1."""

    def __init__(self, dimensions: int, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.01):
        self.z, self.n = np.zeros((dimensions, classes)), np.zeros((dimensions, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = _softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows: list[tuple], y: np.ndarray, classes: int, idf: np.ndarray, epochs: int = 3, seed: int = 3) -> tuple[np.ndarray, float]:
    """(weights, temperature) from the texts' vectors; every fifth text calibrates and is not learned from."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    tune, learn = order[::5], order if len(order) < 10 else np.setdiff1d(order, order[::5])
    model = Ftrl(len(idf), classes)
    for _ in range(epochs):
        for i in rng.permutation(learn):
            model.learn(*rows[i], y[i])
    w = model.weights()
    logits = np.array([x @ w[at] for at, x in (rows[i] for i in tune)])
    grid = np.exp(np.linspace(np.log(0.02), np.log(10), 80))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(tune)), y[tune]], 1e-12)).mean() for t in grid]
    return w, float(grid[int(np.argmin(loss))])


def fold(id_col) -> F.Column:
    """crc32 of the id as text, modulo the number of folds (a null id: the empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def pick(src: DataFrame, per_language: int) -> DataFrame:
    """``(id, lang)``: the first ids of each language in an order of hashed ids; repeated rows of an id are one."""
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = src.select("id", "lang").distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language)
    return materialise(picked.select("id", "lang"), "picked")


def sample_counts(src: DataFrame, picked: DataFrame, dimensions: int) -> DataFrame:
    """``(id, lang, at, n)``: a row per picked id and language, its n-grams' features and their counts."""

    def counted(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                counts = [gram_counts(t, dimensions) for t in part.column(3).to_pylist()]
                some = [np.flatnonzero(c) for c in counts]
                at, n = pa.array([s.astype("<u4").tobytes() for s in some], pa.binary()), pa.array([c[s].astype("<i8").tobytes() for c, s in zip(counts, some)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], at, n], ["id", "lang", "h", "at", "n"])

    sample = src.join(F.broadcast(picked), ["id", "lang"]).select("id", "lang", F.xxhash64("t").alias("h"), "t")  # per_language ids a language
    sample = sample.mapInArrow(counted, "id long, lang string, h long, at binary, n binary")
    # ids may repeat in docs: one row each, combined before the shuffle
    return sample.groupBy("id", "lang").agg(F.min(F.struct("h", "at", "n")).alias("first")).select("id", "lang", "first.at", "first.n")


def train(docs: DataFrame, text_col="text", lang_col="lang", id_col="doc_id", per_language=PER_LANGUAGE, dimensions=DIMENSIONS):
    """(languages, idf-scaled weights, idf, temperature); ``None`` if there is nothing to learn from."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    src = src.where((fold(F.col("id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}"))

    def count(batches):
        df, n = np.zeros(dimensions, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df += gram_counts(t, dimensions) > 0
                n += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], n), pa.int64())], ["f", "n"])

    df = src.select("t").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))
    got = {r.f: r.n for r in lookup_bounded(df, dimensions + 1, "document frequencies")}  # a row a feature
    n = got.pop(-1, 0)
    if not n:
        return None
    idf = np.zeros(dimensions)
    for f, c in got.items():
        idf[f] = np.log((n + 1) / (c + 1)) + 1
    picked = pick(src, per_language)
    langs = sorted(r.lang for r in lookup_bounded(picked.select("lang").distinct(), MAX_LANGUAGES, "languages"))
    sample = sample_counts(src, picked, dimensions)
    number = {x: i for i, x in enumerate(langs)}

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "lang"])
        y = frame["lang"].map(number).to_numpy()
        rows = []
        for a, n in zip(frame["at"], frame["n"]):
            a = np.frombuffer(a, "<u4").astype(np.int64)
            rows.append((a, _weighted(a, np.frombuffer(n, "<i8"), idf)))
        w, temperature = fit(rows, y, len(number), idf)
        at = np.flatnonzero(np.abs(w).sum(axis=1))
        return pd.DataFrame({"f": np.append(at, -1).astype(np.int32), "w": [*w[at].tolist(), [temperature]]})

    rows = sample.groupBy(F.lit(0).alias("one")).applyInPandas(lambda frame: learn(frame), "f int, w array<double>")
    w, temperature = np.zeros((dimensions, len(langs))), 1.0
    for r in materialise(rows, "model").collect():  # a row a feature
        if r.f < 0:
            temperature = r.w[0]
        else:
            w[r.f] = r.w
    return langs, w, idf, temperature


def predict(docs: DataFrame, model, text_col: str = "text", out: tuple = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of ``docs`` plus the language and its calibrated probability.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned; ties go to
    the first language in order. Columns named like the results are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*out)
    names = docs.columns

    def run(batches):
        if shared.value:
            langs, w, idf, temperature = shared.value
        for b in batches:
            lang, score = [], []
            for t, letters in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()):
                if not letters or not shared.value:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at, x = vector(t, idf)
                p = _softmax(x @ w[at] / temperature)
                lang.append(langs[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, *out])

    schema = docs.select("*", F.lit("").alias(out[0]), F.lit(0.0).cast("double").alias(out[1])).schema
    text = F.col(text_col).cast("string")
    return docs.withColumns({"__t": text, "__letters": F.coalesce(text.rlike(r"\p{L}"), F.lit(False))}).mapInArrow(run, schema)
