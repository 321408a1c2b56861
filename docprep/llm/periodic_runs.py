"""Periodic runs of words: stretches that repeat with a period, found over tiles and stitched.

A run of period q keeps ``word[i] == word[i + q]`` over an interval of at least ``3 q`` starts i, and q is
the smallest period of the stretch. Periods are searched by octave, ``S <= q < 2 S``:

1. Tiles. A document is cut into tiles of ``max(tile_words, 16 S)`` words for each octave, each with S words
   more on its left and 5 S on its right. Documents of at most ``tile_words`` words are one tile for all octaves
   and are solved where they are read; the tiles of longer ones are dealt out to other tasks.
2. In a tile every block start c = 0, S, 2 S, ... is a border. An interval of ``3 q`` starts holds two
   whole blocks in a row, so ``[c, c + 2 S)`` equals ``[c + q, c + q + 2 S)`` for one of its borders: hashes of
   2 S words (made by doubling, an octave from the one before) name the (c, q) that can be. The Z-function of the words from c on then
   gives, word by word, how far each such q reaches to the right, and whether a smaller period explains it; the
   Z-values to the left are read for the periods left.
3. The fragments are shuffled by document and period and stitched where they meet or overlap.

Nothing but the fragments, the tiles of long documents and the texts of documents with fragments is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprep.llm.common import materialise

TILE_WORDS = 16_384
MIN_LENGTH = 6
MIN_POWER = 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_ROW = [
    ("kind", pa.int32()), ("doc_id", pa.int64()), ("v", pa.binary()), ("n_words", pa.int64()), ("octave", pa.int32()),
    ("lo", pa.int64()), ("hi", pa.int64()), ("q", pa.int64()), ("data", pa.binary()),
]
_SCHEMA = "kind int, doc_id long, v binary, n_words long, octave int, lo long, hi long, q long, data binary"
_DONE, _FRAGMENT, _TILE, _TEXT = range(4)


class _Codes(dict):
    """word -> number in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


def z_function(s: list[int], n: int) -> list[int]:
    """``z[j]``, j < n: how many words from j on equal those from the start on."""
    z, lo, hi = [0] * n, 0, 0
    if n:
        z[0] = len(s)
    for j in range(1, n):
        k = min(hi - j, z[j - lo]) if j < hi else 0
        while j + k < len(s) and s[k] == s[j + k]:
            k += 1
        z[j] = k
        if j + k > hi:
            lo, hi = j, j + k
    return z


def _prime_parts(q: int) -> list[int]:
    """q / r of every prime r that divides q."""
    out, rest, r = [], q, 2
    while r * r <= rest:
        if rest % r == 0:
            out.append(q // r)
            while rest % r == 0:
                rest //= r
        r += 1
    return [*out, q // rest] if rest > 1 else out


def _doubled(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of twice as many words as those of ``h`` (``step`` words each)."""
    if len(h) <= step:
        return h[:0]
    x = h[:-step] * _A + h[step:]
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def _block_fragments(codes: np.ndarray, c: int, periods: list[int], s: int):
    """(q, lo, hi) of the periods whose starts hold the two blocks from border ``c`` on and are no multiple of a smaller one."""
    z = z_function(codes[c : c + 5 * s].tolist(), 2 * s)
    if any(z[p] >= 4 * s - p for p in range(1, s)):
        return  # a period below this octave explains all of them
    for q in periods:
        right = min(z[q], 3 * s)
        if right < 2 * s or any(z[p] >= q - p for p in _prime_parts(q)):
            continue
        reach = min(c, s)
        apart = np.flatnonzero(codes[c - reach : c] != codes[c - reach + q : c + q])
        yield q, c - (reach - 1 - int(apart[-1]) if len(apart) else reach), c + right


def octave_fragments(codes: np.ndarray, h: np.ndarray, octave: int, first: int = 0, last: int | None = None):
    """(q, lo, hi) in rising order of borders in ``[first, last)``; ``h``: hashes of 2 S words."""
    s = 1 << octave
    rows = max(0, (len(h) - s + s - 1) // s)
    if not rows:
        return
    ahead = np.zeros(rows * s, dtype=np.uint64)
    ahead[: len(h) - s] = h[s : s + rows * s]
    same = ahead.reshape(rows, s) == h[0 : rows * s : s, None]
    left = len(h) - s - (rows - 1) * s
    same[-1, left:] = False
    block, j = np.nonzero(same)
    if not len(block):
        return
    cuts = np.flatnonzero(np.diff(block)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
        c = int(block[lo]) * s
        if c >= first and (last is None or c < last):
            yield from _block_fragments(codes, c, (j[lo:hi] + s).tolist(), s)


class _Merged:
    """Fragments by (document, period), joined where they meet."""

    def __init__(self):
        self.found: dict[tuple[int, int], list[list[int]]] = {}

    def add(self, doc: int, q: int, lo: int, hi: int):
        own = self.found.setdefault((doc, q), [])
        if own and lo <= own[-1][1]:
            own[-1] = [min(own[-1][0], lo), max(own[-1][1], hi)]
        else:
            own.append([lo, hi])


def whole_fragments(docs: list[np.ndarray]) -> _Merged:
    """Fragments of whole documents (word numbers, one numbering for all), all octaves, in one pass an octave over all of them."""
    out = _Merged()
    live = np.flatnonzero([len(d) >= MIN_LENGTH for d in docs])
    octave = 0
    while len(live):
        # documents stand one after another, each behind a word of its own
        sizes = np.array([len(docs[i]) for i in live])
        starts = np.cumsum(sizes + 1) - sizes
        codes = np.full(int(sizes.sum()) + len(live), -1, dtype=np.int64)
        codes[starts - 1] = -1 - np.arange(len(live))
        for i, at in zip(live.tolist(), starts.tolist()):
            codes[at : at + len(docs[i])] = docs[i]
        h = codes.astype(np.uint64) * _A
        h ^= h >> np.uint64(31)
        for k in range(octave):
            h = _doubled(h, 1 << k)
        longest = int(sizes.max())
        while longest >= max(MIN_LENGTH, MIN_POWER << octave):
            h = _doubled(h, 1 << octave)
            for q, lo, hi in octave_fragments(codes, h, octave):
                k = int(np.searchsorted(starts, lo, "right")) - 1
                out.add(int(live[k]), q, lo - int(starts[k]), hi - int(starts[k]))
            octave += 1
            still = sizes >= MIN_POWER << octave
            if sizes[still].sum() * 2 < sizes.sum():  # most words are in documents too short for the octave
                break
        live = live[sizes >= max(MIN_LENGTH, MIN_POWER << octave)]
    return out


def tiles(codes: np.ndarray, tile_words: int):
    """(octave, start, words) of a long document's tiles; borders of the own part of a tile lie from S on (from 0 at the start)."""
    n, octave = len(codes), 0
    while n >= max(MIN_LENGTH, MIN_POWER << octave):
        s = 1 << octave
        own = max(-(-tile_words // s), 16) * s
        for a in range(0, n, own):
            yield octave, max(0, a - s), codes[max(0, a - s) : a + own + 5 * s]
        octave += 1


def tile_fragments(codes: np.ndarray, octave: int, start: int, tile_words: int) -> _Merged:
    """Fragments of one tile, in words of the document."""
    s = 1 << octave
    own = max(-(-tile_words // s), 16) * s
    first = 0 if start == 0 else s
    h = codes.astype(np.uint64) * _A
    h ^= h >> np.uint64(31)
    for k in range(octave + 1):
        h = _doubled(h, 1 << k)
    out = _Merged()
    for q, lo, hi in octave_fragments(codes, h, octave, first, first + own):
        out.add(0, q, start + lo, start + hi)
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _ROW)], [n for n, _ in _ROW])


def _read(docs: DataFrame, tile_words: int) -> DataFrame:
    """Rows of four kinds: finished documents, fragments, tiles, and the texts of documents that are not finished."""

    def run(batches):
        for b in batches:
            ids, numbers, words_of, rows = b.column(0).to_pylist(), _Codes(), [], []
            for t in b.column(1).to_pylist():
                words_of.append((t or b"").split())
            short = [len(w) <= tile_words for w in words_of]
            codes = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) if own else None for w, own in zip(words_of, short)]
            found = whole_fragments([c if c is not None else np.empty(0, np.int64) for c in codes]).found
            open_ = {k for k, _ in found}
            keys = {}
            for k, (d, w) in enumerate(zip(ids, words_of)):
                text = b" ".join(w)
                if k not in open_ and short[k]:
                    rows.append((_DONE, d, None, len(w), None, None, None, None, text))
                    continue
                keys[k] = hashlib.sha256(text).digest()[:16]
                rows.append((_TEXT, d, keys[k], len(w), None, None, None, None, text))
                if not short[k]:
                    own = np.fromiter(map(_Codes().__getitem__, w), np.int32, len(w))
                    rows += [(_TILE, d, keys[k], len(w), octave, start, None, None, part.tobytes()) for octave, start, part in tiles(own, tile_words)]
            rows += [(_FRAGMENT, ids[k], keys[k], None, None, lo, hi, q, None) for (k, q), own in found.items() for lo, hi in own]
            for lo in range(0, len(rows), 2_000):
                yield _batch(rows[lo : lo + 2_000])

    return docs.mapInArrow(run, _SCHEMA)


def _solved(tile_rows: DataFrame, tile_words: int) -> DataFrame:
    def run(batches):
        kind = [("doc_id", pa.int64()), ("v", pa.binary()), ("q", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]
        for b in batches:
            rows = []
            for d, v, octave, start, data in zip(*(c.to_pylist() for c in b.columns)):
                found = tile_fragments(np.frombuffer(data, np.int32).astype(np.int64), octave, start, tile_words).found
                rows += [(d, v, q, lo, hi) for (_, q), own in found.items() for lo, hi in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kind)], [n for n, _ in kind])

    # a long document's tiles go to different tasks
    dealt = tile_rows.select("doc_id", "v", "octave", "lo", "data").repartition("v", "octave", "lo")
    return dealt.mapInArrow(run, "doc_id long, v binary, q long, lo long, hi long")


def stitched(fragments: DataFrame) -> DataFrame:
    """``(doc_id, v, start, length, period)``: fragments of one document and period joined where they meet; long enough ones only."""
    # repeated rows of a document give equal fragments: combined before the shuffle
    whole = fragments.select("doc_id", "v", "q", "lo", "hi").distinct()
    by = Window.partitionBy("doc_id", "v", "q").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parts = whole.withColumn("new", F.coalesce(F.col("lo") > before, F.lit(True)).cast("int"))
    parts = parts.withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parts.groupBy("doc_id", "v", "q", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    length = F.col("hi") - F.col("lo") + F.col("q")
    runs = runs.where((length >= MIN_LENGTH) & (length >= MIN_POWER * F.col("q")))
    return runs.select("doc_id", "v", F.col("lo").alias("start"), length.alias("length"), F.col("q").alias("period"))


def collapsed(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for r in runs:
        gone[r["start"] + r["period"]] += 1
        gone[r["start"] + r["length"]] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tile_words: int = TILE_WORDS) -> DataFrame:
    """``(doc_id, n_words, runs array<struct<start, length, period>>, collapsed_text)`` for every row of ``docs``.

    Runs are ordered by start, then period. ``collapsed_text`` joins by single blanks the words that no run holds after its
    first period. Null and empty texts have no words and no runs. Rows with a null doc_id and repeated rows are results of their own;
    other columns are ignored. An empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    rows = materialise(_read(src, tile_words), "periodic_rows")
    fragments = rows.where(F.col("kind") == _FRAGMENT).select("doc_id", "v", "q", "lo", "hi")
    fragments = fragments.unionByName(_solved(rows.where(F.col("kind") == _TILE), tile_words))
    runs = stitched(fragments).groupBy("doc_id", "v").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = runs.select(F.col("doc_id").alias("d"), F.col("v").alias("w"), "runs")
    texts = rows.where(F.col("kind") == _TEXT).select("doc_id", "v", "n_words", "data")
    texts = texts.join(runs, (F.col("v") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "n_words", "data", "runs")

    def run(batches):
        for b in batches:
            texts = [b" ".join(collapsed(t.split(), r)).decode() if r else t.decode() for t, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed_text"])

    order = "array<struct<start:long,period:long,length:long>>"
    cut = texts.mapInArrow(run, f"doc_id long, n_words long, runs {order}, collapsed_text string")
    named = F.transform(F.coalesce("runs", F.array().cast(order)), lambda r: F.struct(r.start.alias("start"), r.length.alias("length"), r.period.alias("period")))
    cut = cut.withColumn("runs", named)
    done = rows.where(F.col("kind") == _DONE).select("doc_id", "n_words", F.array().cast(RUNS).alias("runs"), F.col("data").cast("string").alias("collapsed_text"))
    return done.unionByName(cut)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly (ties: smallest start, then period; none: null)."""

    def better(best: Column, r: Column) -> Column:
        mine, its = r.length * best.period, best.length * r.period
        return F.when(best.isNull() | (mine > its), r).otherwise(best)

    # runs are ordered by start, then period: the first of equals stays
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def with_repetition(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Damaged texts: of documents whose ``crc32(doc_id) % 10`` is 0, the words from one on repeat with a period.

    With h the CRC-32 of the decimal id and g = h / 10: word i >= a becomes word a + (i - a) % p, a = g % n,
    p = 1 + (n - a) / (3 + g % 8). Texts without words and rows without an id stay.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col).cast("string"), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    damaged = docs.withColumn("__h", h).withColumn("__g", F.floor(F.col("__h") / 10).cast("long"))
    hit = (F.col("__h") % 10 == 0) & F.col(text_col).isNotNull()
    damaged = damaged.withColumn("__w", F.when(hit, words))
    n = F.size("__w").cast("long")
    damaged = damaged.withColumn("__a", F.when(n > 0, F.col("__g") % n))
    damaged = damaged.withColumn("__p", F.expr("1 + (size(__w) - __a) div (3 + __g % 8)"))
    cut = F.expr("array_join(transform(__w, (w, i) -> if(i < __a, w, __w[int(__a + (i - __a) % __p)])), ' ')")
    text = F.when(hit & (n > 0), cut).otherwise(F.col(text_col))
    return damaged.withColumn(text_col, text).drop("__h", "__g", "__w", "__a", "__p")
