"""Benchmark decontamination by latent semantic retrieval.

1. Passages are ``2 * HALF`` words long and overlap by half. The terms are the
   benchmark's words (case and punctuation around a word do not matter). One pass over
   all passages counts how many hold each term and accumulates the range sketch
   ``A'(A W)`` of the term-passage matrix; because inverse document frequency only scales
   terms, it is applied to the sketch afterwards and one pass is enough.
2. The benchmark's own TF-IDF rows join the sketch with equal energy, so rare items have
   their directions. Nystrom's single-pass form of the randomised SVD turns the sketch into
   the ``RANK`` leading term directions.
3. A second pass folds every passage into that space and takes the items whose cosine
   is at least ``COSINE``. Beside it, every run of ``RUN`` item words in a row (words of no item
   between them do not matter) is looked up among the items' own runs, so whole copies do not
   depend on the space. Candidates of both kinds are then confirmed in the same task: the longest common
   subsequence of the item and the words around the passage, and that of the item's
   answer (its last sentence), must cover enough of them.

Only term rows (bounded by the benchmark block) reach the driver. Benchmarks larger than
``ITEM_BLOCK`` items run block by block against all documents. ``matches`` turns whole texts into
term numbers once (a table in the shared folder) and both passes read the numbers;
``decontaminated`` carries the rows' own columns and reads the texts in both passes.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.llm.common import lookup_bounded, materialise, text_bytes, with_text

HALF = 32
RANK = 128
OVERSAMPLE = 16
COSINE = 0.45
LCS = 0.6
ANSWER = 0.6
VERBATIM = 0.8
MIN_WORDS = 5
RUN = 5  # words in a row that make a candidate whatever its cosine
ITEM_BLOCK = 4_000
MAX_TERMS = 400_000
FREQUENT = 64
_BLOCKS = 4_096  # half passages folded in at once
_STEPS = 64
_LOOKUPS = 1_024  # runs whose items are listed at once
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def normal_words(text: str | None) -> list[str]:
    return [w for w in (_EDGE.sub("", x) for x in (text or "").lower().split()) if w]


def answer_words(text: str | None) -> list[str]:
    """The words of the item's last sentence of two or more words; of a single sentence, its last third."""
    parts = [normal_words(s) for s in _SENTENCE.split((text or "").strip())]
    parts = [p for p in parts if p]
    for p in reversed(parts[1:]):
        if len(p) > 1:
            return p
    words = normal_words(text)
    return words[-max(1, len(words) // 3) :]


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = masks.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class _Terms:
    """Term numbers of a text's words, -1 for words of no item.

    Most words are looked up as they stand; only unknown words with a character other
    than letters and digits are stripped at their edges first.
    """

    def __init__(self, number: dict[str, int]):
        self.get = number.get
        self.stripped: dict[str, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").decode("utf-8", "replace").lower().split()
        out = np.fromiter(map(self.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        at = np.flatnonzero(out < 0).tolist()
        unknown = [words[i] for i in at]
        if len(self.stripped) > 200_000:
            self.stripped.clear()
        for i, w, plain in zip(at, unknown, map(str.isalnum, unknown)):
            if not plain:
                k = self.stripped.get(w)
                if k is None:
                    k = self.stripped[w] = self.get(_EDGE.sub("", w), -1)
                out[i] = k
        return out


def _code(n_terms: int) -> np.dtype:
    return np.dtype("<i2" if n_terms < 32_768 else "<i4")


def _reader(number: dict[str, int], coded: bool):
    """Column of texts, or of stored term numbers, -> term numbers by row."""
    if coded:
        code = _code(len(number))
        return lambda column: [np.frombuffer(x or b"", dtype=code) for x in column.to_pylist()]
    terms = _Terms(number)
    return lambda column: [terms(x) for x in text_bytes(column)]


def _numbered(rows: DataFrame, number: dict[str, int]) -> DataFrame:
    """``(doc_id, t)`` with the texts ``t`` replaced by their words' term numbers, stored."""
    shared, code = rows.sparkSession.sparkContext.broadcast(number), _code(len(number))

    def run(batches):
        terms = _Terms(shared.value)
        for b in batches:
            coded = pa.array([terms(t).astype(code).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), coded], ["doc_id", "t"])

    return materialise(rows.select("doc_id", "t").mapInArrow(run, "doc_id long, t binary"), "term_numbers")


class Passages:
    """Terms of a batch of texts by half passage; half passages of one text follow each other."""

    def __init__(self, texts: list[np.ndarray]):
        self.terms = texts
        sizes = np.array([len(w) for w in texts], dtype=np.int64)
        halves = -(-sizes // HALF)
        self.first = np.cumsum(halves) - halves  # first half passage of each text
        self.text_of = np.repeat(np.arange(len(texts)), halves)
        within = [np.arange(n) // HALF for n in sizes]
        idx = np.concatenate(self.terms) if self.terms else np.empty(0, np.int32)
        at = np.concatenate([w + f for w, f in zip(within, self.first)]) if within else np.empty(0, np.int64)
        known = idx >= 0
        self.idx, self.at = idx[known].astype(np.int64), at[known]
        self.n = int(halves.sum())

    def parts(self, step: int = _BLOCKS):
        """(first, last + 1, own) ranges of half passages; each overlaps the next by one, own ends before it."""
        for lo in range(0, self.n, step):
            yield lo, min(lo + step + 1, self.n), min(lo + step, self.n)

    def rows(self, lo: int, hi: int, frequent: int):
        """Term occurrences of a range: counts of the frequent terms (dense) and the others' (at, idx)."""
        a, b = np.searchsorted(self.at, (lo, hi))
        at, idx = self.at[a:b] - lo, self.idx[a:b]
        often = idx < frequent
        dense = np.bincount(at[often] * frequent + idx[often], minlength=(hi - lo) * frequent).reshape(hi - lo, frequent)
        return dense.astype(np.float32), at[~often], idx[~often]


def _run_hashes(terms: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` terms."""
    n = max(0, len(terms) - size + 1)
    x = terms.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = (h + x[k : k + n] + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
    return h


class _Runs:
    """The items that hold a run of ``RUN`` words (an item of fewer words: all of its words)."""

    def __init__(self, items: list[list[int]]):
        self.tables = []
        for size in sorted({min(RUN, len(w)) for w in items if w}):
            own = [(k, np.unique(_run_hashes(np.array(w), size))) for k, w in enumerate(items) if min(RUN, len(w)) == size]
            keys = np.concatenate([h for _, h in own])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], np.repeat([k for k, _ in own], [len(h) for _, h in own])[order]
            shift = np.uint64(64 - max(16, len(keys).bit_length() + 4))
            some = np.zeros(1 << (64 - int(shift)), dtype=bool)  # first bits that some key has
            some[keys >> shift] = True
            self.tables.append((size, keys, owner, shift, some))

    def found(self, p: Passages, lo: int, own: int):
        """(half passages from ``lo`` on, items) of the runs that begin in a range of half passages."""
        a, b = np.searchsorted(p.at, (lo, own))
        for size, keys, owner, shift, some in self.tables:
            h = _run_hashes(p.idx[a : b + size - 1], size)
            at = np.flatnonzero(some[h >> shift])
            at = at[p.text_of[p.at[a + at]] == p.text_of[p.at[a + at + size - 1]]]
            for k in range(0, len(at), _LOOKUPS):
                part = at[k : k + _LOOKUPS]
                first, n = np.searchsorted(keys, h[part]), np.searchsorted(keys, h[part], "right")
                n -= first
                which = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
                yield np.repeat(p.at[a + part] - lo, n), owner[which]


def _add_runs(out: np.ndarray, keys: np.ndarray, rows: np.ndarray, pick: np.ndarray) -> None:
    """``out[k] +=`` the sum of ``rows[pick]`` over the run of ``k`` in the ordered ``keys``.

    The runs' first members are added together, then their second ones and so on, longest run
    first; what a run holds beyond ``_STEPS`` members is summed alone (at most one such run per ``_STEPS`` keys).
    """
    if not len(keys):
        return
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    sizes = np.diff(starts, append=len(keys))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    acc = rows[pick[starts]]
    for step in range(1, min(int(sizes[0]), _STEPS)):
        n = np.searchsorted(-sizes, -step)  # runs of more than ``step`` members
        acc[:n] += rows[pick[starts[:n] + step]]
    for k in range(np.searchsorted(-sizes, -_STEPS)):
        acc[k] += rows[pick[starts[k] + _STEPS : starts[k] + sizes[k]]].sum(axis=0)
    out[keys[starts]] += acc


def _fold(dense, at, idx, basis: np.ndarray) -> np.ndarray:
    """Sums of the term rows of ``basis`` by half passage."""
    out = dense @ basis[: dense.shape[1]]
    _add_runs(out, at, basis, idx)
    return out


def _pairs(x: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Passages from half passages: each with its successor in the same text."""
    out = x.copy()
    same = np.flatnonzero(texts[:-1] == texts[1:])
    out[same] += x[same + 1]
    return out


def _sketch_pass(docs: DataFrame, coded: bool, number: dict[str, int], frequent: int, width: int, seed: int):
    """(passages, term -> passages that hold it, sketch rows) over all documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(number)
    n_terms = len(number)

    def run(batches):
        read = _reader(shared.value, coded)
        omega = np.random.default_rng(seed).standard_normal((n_terms, width), dtype=np.float32)
        z = np.zeros((n_terms, width), dtype=np.float32)
        df = np.zeros(n_terms, dtype=np.int64)
        seen = 0
        for b in batches:
            p = Passages(read(b.column(0)))
            seen += p.n
            for lo, hi, own in p.parts():
                dense, at, idx = p.rows(lo, own, frequent)
                y = _fold(dense, at, idx, omega)
                z[:frequent] += dense.T @ y
                df[:frequent] += (dense > 0).sum(axis=0)
                if len(idx):
                    order = np.argsort(idx, kind="stable")
                    i, a = idx[order], at[order]
                    _add_runs(z, i, y, a)
                    once = (np.diff(i, prepend=-1) != 0) | (np.diff(a, prepend=-1) != 0)
                    df += np.bincount(i[once], minlength=n_terms)
        some = np.flatnonzero(df)
        for lo in range(0, len(some), 2048):
            s = some[lo : lo + 2048]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s, pa.int32()), pa.array(df[s], pa.int64()), pa.array([r.tobytes() for r in z[s]], pa.binary())], ["term", "df", "z"]
            )
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([seen], pa.int64()), pa.array([None], pa.binary())], ["term", "df", "z"])

    def add(batches):
        df, z = {}, {}
        for b in batches:
            for t, n, row in zip(*(b.column(k).to_pylist() for k in range(3))):
                df[t] = df.get(t, 0) + n
                if row is not None:
                    row = np.frombuffer(row, dtype=np.float32).astype(np.float64)
                    z[t] = z[t] + row if t in z else row
        keys = list(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), pa.array([df[t] for t in keys], pa.int64()), pa.array([z[t].tobytes() if t in z else None for t in keys], pa.binary())], ["term", "df", "z"]
        )

    schema = "term int, df long, z binary"
    total = materialise(docs.select("t").mapInArrow(run, schema).repartition("term").mapInArrow(add, schema), "sketch")
    df, z, seen = np.zeros(n_terms, np.int64), np.zeros((n_terms, width)), 0
    for r in lookup_bounded(total, MAX_TERMS + 1, "benchmark terms"):  # a row a term
        if r.term < 0:
            seen += r.df
        else:
            df[r.term], z[r.term] = r.df, np.frombuffer(r.z)
    return seen, df, z


def latent_space(docs: DataFrame, coded: bool, items: list[list[int]], number: dict[str, int], frequent: int, rank: int, seed: int = 17):
    """(idf-scaled basis, item directions): what folds term counts into the latent space, and the items in it."""
    n_terms = len(number)
    width = min(rank + OVERSAMPLE, n_terms)
    seen, df, z = _sketch_pass(docs, coded, number, frequent, width, seed)
    idf = np.log((seen + 1) / (df + 1)) + 0.1
    b = np.zeros((len(items), n_terms))
    for k, words in enumerate(items):
        np.add.at(b[k], words, 1)
    b *= idf
    b /= np.maximum(np.sqrt((b * b).sum(axis=1, keepdims=True)), 1e-12)
    # with W = D^-1 G (G Gaussian, D the idf): (A_tf D)'(A_tf D) W = D A_tf'(A_tf G)
    omega = np.random.default_rng(seed).standard_normal((n_terms, width), dtype=np.float32) / idf[:, None]
    corpus, own = z * idf[:, None], b.T @ (b @ omega)
    sketch = corpus / max(np.linalg.norm(corpus), 1e-12) + own / max(np.linalg.norm(own), 1e-12)
    q, r = np.linalg.qr(sketch)
    core = omega.T @ sketch
    u, s, _ = np.linalg.svd(r @ np.linalg.pinv((core + core.T) / 2, rcond=1e-8) @ r.T)
    basis = (q @ u[:, :rank]) * idf[:, None]
    tf = np.zeros((len(items), n_terms))
    for k, words in enumerate(items):
        np.add.at(tf[k], words, 1)
    folded = tf @ basis
    return basis.astype(np.float32), (folded / np.maximum(np.linalg.norm(folded, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _check(words: np.ndarray, start: int, item: list[int], answer: list[int], least: float) -> tuple[float, float] | None:
    """Shares of the item and of its answer that the words around the passage hold in order; None if
    they hold, in any order, less than ``least`` of the item's words, which bounds the first share."""
    reach = len(item)
    around = words[max(0, start - reach) : start + 2 * HALF + reach]
    around = around[around >= 0].tolist()
    if sum(map(set(around).__contains__, item)) < least * reach:
        return None
    return lcs_length(item, around) / reach, lcs_length(answer, around) / len(answer)


def _search(docs, coded: bool, names: list[str], text_at: int, items, answers, ids, number, frequent, basis, directions, cosine, lcs, answer_share, verbatim, schema):
    """Rows of ``docs`` (the columns ``names``; texts or term numbers at ``text_at``) through ``schema[1]`` with their matches."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((number, items, answers, ids, basis, directions, _Runs(items)))
    least = min(lcs, verbatim) - 1e-9

    def run(batches):
        number, items, answers, ids, basis, directions, runs = shared.value
        read = _reader(number, coded)
        for b in batches:
            p = Passages(read(b.column(text_at)))
            best: dict[tuple[int, int], tuple] = {}
            for lo, hi, own in p.parts():
                x = _fold(*p.rows(lo, hi, frequent), basis)
                x = _pairs(x, p.text_of[lo:hi])[: own - lo]
                x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
                near = x @ directions.T
                candidate = near >= cosine
                for at, held in runs.found(p, lo, own):
                    candidate[at, held] = True
                for h, k in zip(*(c.tolist() for c in np.nonzero(candidate))):
                    text = int(p.text_of[lo + h])
                    start = int(lo + h - p.first[text]) * HALF
                    shares = _check(p.terms[text], start, items[k], answers[k], least)
                    if shares is None:
                        continue
                    share, answered = shares
                    if (share >= lcs and answered >= answer_share) or share >= verbatim:
                        found = (share, answered, float(near[h, k]))
                        best[text, k] = max(best.get((text, k), found), found)
            yield from schema[1](b, names, best, ids)

    return docs.mapInArrow(run, schema[0])


def _prepare(benchmark: DataFrame, text_col: str, id_col: str, min_words: int):
    src = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    ids = sorted(r.i for r in src.select("i").distinct().collect())
    for lo in range(0, len(ids), ITEM_BLOCK):
        block = ids[lo : lo + ITEM_BLOCK]
        rows = sorted((r.i, r.t) for r in src.where(F.col("i").between(block[0], block[-1])).collect())
        rows = [(i, w, answer_words(t)) for i, t in rows if len(w := normal_words(t)) >= min_words]
        if not rows:
            continue
        count: dict[str, int] = {}
        for _, words, _ in rows:
            for w in words:
                count[w] = count.get(w, 0) + 1
        order = sorted(count, key=lambda w: (-count[w], w))  # the first FREQUENT terms are counted densely
        number = {w: k for k, w in enumerate(order)}
        yield [r[0] for r in rows], [[number[w] for w in r[1]] for r in rows], [[number[w] for w in r[2]] for r in rows], number


def _match_rows(b, names, best, ids):
    if best:
        rows = [(b.column(0)[t].as_py(), ids[k], *v) for (t, k), v in sorted(best.items())]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "item_id", "lcs_share", "answer_share", "cosine"])


def _clean_rows(b, names, best, ids):
    keep = np.ones(b.num_rows, dtype=bool)
    keep[[t for t, _ in best]] = False
    yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names).filter(pa.array(keep))


MATCHES = "doc_id long, item_id long, lcs_share double, answer_share double, cosine double"


def _space(src: DataFrame, coded: bool, items, number, rank):
    frequent = min(FREQUENT, len(number))
    return frequent, *latent_space(src.select("t"), coded, items, number, frequent, min(rank, len(number)))


def matches(
    docs: DataFrame, benchmark: DataFrame, text_col="text", id_col="doc_id", bench_text="text", bench_id="item_id",
    cosine=COSINE, lcs=LCS, answer=ANSWER, verbatim=VERBATIM, min_words=MIN_WORDS, rank=RANK,
) -> DataFrame:
    """``(doc_id, item_id, lcs_share, answer_share, cosine)``: a row per row of ``docs`` and item it holds.

    Whole texts are searched; null and empty texts hold nothing. Items that are null or have fewer than
    ``min_words`` words are not searched for; an item_id with several texts is several items. Repeated rows
    give repeated matches. No documents or no items give an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for ids, items, answers, number in _prepare(benchmark, bench_text, bench_id, min_words):
        coded = _numbered(rows, number)
        frequent, basis, directions = _space(coded, True, items, number, rank)
        found = _search(coded, True, ["doc_id"], 1, items, answers, ids, number, frequent, basis, directions, cosine, lcs, answer, verbatim, (MATCHES, _match_rows))
        out = out.unionByName(found)
    return out


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col="text", bench_text="text", bench_id="item_id",
    cosine=COSINE, lcs=LCS, answer=ANSWER, verbatim=VERBATIM, min_words=MIN_WORDS, rank=RANK,
) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no item; without items all rows."""
    names, whole = docs.columns, docs.select(F.col(text_col).cast("binary").alias("t"))
    for ids, items, answers, number in _prepare(benchmark, bench_text, bench_id, min_words):
        frequent, basis, directions = _space(whole, False, items, number, rank)
        rows, at = with_text(docs, text_col)
        docs = _search(rows, False, names, at, items, answers, ids, number, frequent, basis, directions, cosine, lcs, answer, verbatim, (docs.schema, _clean_rows))
    return docs
