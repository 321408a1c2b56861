"""Toxicity scores by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts (P) and unlabelled texts (U). The risk of a
linear model is corrected by the class prior pi:

    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))

and a mini-batch whose second term is negative takes a step that raises it
instead (the non-negative estimator's correction). Features are the distinct words of a
text and their beginnings; those kept are significantly more frequent in P than in U.

Only the fit works on bounded samples (``max_positive``, ``max_unlabelled`` ids, the
first ones in an order of hashed ids; of an id's several rows the text with the smallest
hash counts); the prior counts all labelled rows and the
scores cover whole texts of all rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.llm.common import lookup_bounded, materialise, text_bytes, with_text

MAX_POSITIVE = 8_000
MAX_UNLABELLED = 24_000
FEATURES = 4_096
MIN_POSITIVE = 3  # confirmed texts that hold a feature
MIN_CHI2 = 30.0  # of the feature's share in P against that in U, one text discounted
PREFIXES = (4, 5, 6)  # inflected words share their first characters
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
CACHE_BYTES = 32 * 1024 * 1024
LONGEST_KEPT = 256  # bytes of a word that is remembered
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class _Features(dict):
    """raw word (bytes) -> hashes of the word and of its first characters; case and punctuation around it do not matter.

    With ``only``, hashes outside it are left out. Words are forgotten together when they take ``CACHE_BYTES``.
    """

    def __init__(self, only: dict[int, float] | None = None):
        super().__init__()
        self.only, self.weight = only, 0

    def __missing__(self, raw: bytes) -> tuple[int, ...]:
        if self.weight > CACHE_BYTES:
            self.clear()
            self.weight = 0
        word = _EDGE.sub("", raw.decode("utf-8", "replace").lower())
        names = [word] * bool(word) + [word[:k] + "*" for k in PREFIXES if len(word) > k]
        found = [xxhash.xxh64_intdigest(x.encode(), 11) >> 1 for x in names]
        found = tuple(found if self.only is None else [f for f in found if f in self.only])
        self.weight += 150 + len(raw) + 36 * len(found)
        if len(raw) <= LONGEST_KEPT:
            self[raw] = found
        return found


def features(text: bytes | None, cache: _Features) -> set[int]:
    return set().union(*map(cache.__getitem__, set((text or b"").split())))


def fold(id_col) -> F.Column:
    """crc32 of the id as text, modulo the number of folds (a null id: the empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def fit_nnpu(p: list[np.ndarray], u: list[np.ndarray], n_features: int, prior: float, epochs: int = 100, batch: int = 2048, rate: float = 0.05, l2: float = 1e-4, seed: int = 5):
    """Weights and bias of the logistic model; p and u hold feature numbers per text."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    mw, vw, mb, vb, t = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    rounds = max(1, -(-len(u) // batch))

    def rows(items, pick):
        chosen = [items[i] for i in pick]
        at = np.repeat(np.arange(len(chosen)), [len(x) for x in chosen])
        return at, np.concatenate(chosen) if len(at) else np.empty(0, np.int64), len(chosen)

    def margin(block):
        at, cols, n = block
        return np.bincount(at, w[cols], n) + b

    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        po, uo = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(rounds):
            bp, bu = rows(p, po[k::rounds] if len(po) >= rounds else po), rows(u, uo[k::rounds])
            zp, zu = margin(bp), margin(bu)
            # logistic loss: R(+) = mean log(1 + e^-z), R(-) = mean log(1 + e^z)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp = (prior / bp[2]) * (sig(zp) - 1) if negative >= 0 else np.zeros(bp[2])
            sign = 1.0 if negative >= 0 else -1.0
            gp = gp - sign * (prior / bp[2]) * sig(zp)
            gu = sign * sig(zu) / bu[2]
            g = np.bincount(bp[1], gp[bp[0]], n_features) + np.bincount(bu[1], gu[bu[0]], n_features) + l2 * w
            gb = gp.sum() + gu.sum()
            t += 1
            mw, vw = 0.9 * mw + 0.1 * g, 0.999 * vw + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            w -= rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.999**t)) + 1e-8)
            np.maximum(w, 0, out=w)  # every feature kept speaks for P
            b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    # match the prior: the unlabelled texts' mean score is pi; of a few slopes the one with the least risk
    zp, zu = (margin(rows(items, np.arange(len(items)))) - b for items in (p, u))
    best = None
    for slope in (1.0, 1.5, 2.0, 3.0, 4.0):
        lo, hi = -40.0, 20.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sig(slope * zu + mid).mean() < prior else (lo, mid)
        yp, yu = slope * zp + lo, slope * zu + lo
        risk = prior * np.logaddexp(0, -yp).mean() + max(0.0, np.logaddexp(0, yu).mean() - prior * np.logaddexp(0, yp).mean())
        if best is None or risk < best[0] - 1e-9:
            best = (risk, slope, lo)
    return w * best[1], best[2]


def train(
    docs: DataFrame, labels: DataFrame, text_col="text", id_col="doc_id", max_positive=MAX_POSITIVE, max_unlabelled=MAX_UNLABELLED, n_features=FEATURES
) -> tuple[dict[int, float], float]:
    """(weight per feature hash, bias). Labels count only outside the held-out fold; a doc_id with
    several labels is toxic if any says so, null labels are none. Without a toxic label every weight is 0
    and the score is the prior of one half of a case."""
    labels = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.where((fold(F.col("id")) != HELD_OUT) & F.col("toxic").isNotNull() & F.col("id").isNotNull())
    per_id = materialise(labels.groupBy("id").agg(F.max("toxic").alias("toxic")), "labels")
    n, toxic = per_id.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).collect()[0]
    prior = min(0.9, max(1e-4, (toxic + 0.5) / (n + 1)))
    bias = float(np.log(prior / (1 - prior)))
    if not toxic:
        return {}, bias
    order = F.xxhash64("id")
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where((fold(F.col("id")) != HELD_OUT) & F.col("id").isNotNull())
    positive = per_id.where("toxic = 1").select("id", F.lit(1).alias("p")).orderBy(order, "id").limit(max_positive)
    unlabelled = ids.distinct().select("id", F.lit(0).alias("p")).orderBy(order, "id").limit(max_unlabelled)
    sample = materialise(positive.unionByName(unlabelled), "sample")

    def run(batches):
        cache = _Features()
        for b in batches:
            found = [sorted(features(t, cache)) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["p", "id", "h", "features"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    # at most max_positive + max_unlabelled ids are broadcast; the texts stay where they are
    rows = src.join(F.broadcast(sample), "id").select("p", "id", F.xxhash64("t").alias("h"), "t")
    rows = rows.mapInArrow(run, "p int, id long, h long, features array<long>")
    # ids may repeat in docs: one row each, combined before the shuffle
    rows = rows.groupBy("p", "id").agg(F.min(F.struct("h", "features")).alias("first"))
    rows = materialise(rows.select("p", "id", F.col("first.features").alias("features")), "features")
    n_p, n_u = rows.agg(F.count_if(F.col("p") == 1), F.count_if(F.col("p") == 0)).collect()[0]
    if not n_p or not n_u:
        return {}, bias
    counts = rows.select("p", F.explode("features").alias("f")).groupBy("f").agg(F.sum("p").alias("cp"), F.sum(1 - F.col("p")).alias("cu"))
    cp = F.col("cp") - 1
    share = (cp + F.col("cu") + 0.5) / (n_p + n_u)
    apart = cp / n_p - F.col("cu") / n_u
    chi2 = apart * apart / (share * (1 - share) * (1 / n_p + 1 / n_u))
    kept = counts.where((F.col("cp") >= MIN_POSITIVE) & (apart > 0) & (share < 1) & (chi2 >= MIN_CHI2)).orderBy(chi2.desc(), "f").limit(n_features)
    names = sorted(r.f for r in kept.select("f").collect())
    number = {f: i for i, f in enumerate(names)}
    wanted = rows.sparkSession.sparkContext.broadcast(number)

    def narrow(batches):
        for b in batches:
            got = [[wanted.value[f] for f in fs if f in wanted.value] for fs in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(got, pa.list_(pa.int32()))], ["p", "id", "features"])

    rows = rows.mapInArrow(narrow, "p int, id long, features array<int>")
    got = sorted(lookup_bounded(rows, max_positive + max_unlabelled, "training sample"), key=lambda r: (r.p, r.id))  # a row an id
    p = [np.array(r.features, dtype=np.int64) for r in got if r.p == 1]
    u = [np.array(r.features, dtype=np.int64) for r in got if r.p == 0]
    w, b = fit_nnpu(p, u, len(names), prior)
    return {f: float(w[i]) for f, i in number.items()}, float(b)


def scores(docs: DataFrame, model: tuple[dict[int, float], float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus the score of the whole text (0 to 1; a null text counts as empty).

    A column of ``docs`` named like the score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most n_features weights
    docs = docs.drop(score_col)
    names = docs.columns
    rows, at = with_text(docs, text_col)

    def run(batches):
        weights, bias = shared.value
        cache, get = _Features(weights), weights.__getitem__
        for b in batches:
            z = [bias + sum(map(get, features(t, cache))) for t in text_bytes(b.column(at))]
            s = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(s, pa.float64())], [*names, score_col])

    schema = docs.select("*", F.lit(0.0).cast("double").alias(score_col)).schema
    return rows.mapInArrow(run, schema)
