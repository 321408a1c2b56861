"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window
over it also starts in a document with a smaller doc_id.

1. Anchors. The smallest hash of the 5-word groups inside a window is a function
   of the window's words alone, so all occurrences of a window share it. Each
   document lists its distinct anchors (about one for five windows); an anchor that two
   different texts list may belong to a recurring passage. Equal texts count as
   one text here: every copy but the one with the smallest doc_id goes whole.
2. Stretches. The words around such anchors are cut from the whole texts and dealt by anchor into
   shards of a bounded number of stretches, a task each.
3. Confirmation and automata. A task writes each word of its shard as one character and confirms,
   word by word, the windows that two or more documents hold. Each confirmed window, whole, is a pattern of the shard's automaton;
   its value is the smallest doc_id that holds it.
4. All stretches of the shard, of every document, stream through the automaton: each match is an
   occurrence of a window. Runs found are collected per text and cut from it.

An anchor that very many documents list is dealt over salts; its windows are confirmed per salt, merged, and
handed as patterns to the shard of every salt.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.llm.common import materialise, text_bytes, with_text

WINDOW = 13
GROUP = 5
SALT_ROWS = 4096
SHARD_STRETCHES = 30_000
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ODD = np.array([0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF | 1 for k in range(1, 65)], dtype=np.uint64)


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_LONG = 64  # bytes of a word that are hashed eight at a time


class Words:
    """Words of a batch of texts: byte ranges in ``raw`` and 64-bit hashes, ``first[i]:first[i + 1]`` those of text i."""

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        self.raw = b"\n".join(texts) + b"\n" * 9
        b = np.frombuffer(self.raw, dtype=np.uint8)
        blank = np.concatenate([[True], _BLANK[b]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, at)
        self.hashes = self._hashes(b)

    def _hashes(self, b: np.ndarray) -> np.ndarray:
        eight = np.ndarray((len(b) - 7,), dtype="<u8", buffer=self.raw, strides=(1,))
        size = self.ends - self.starts
        h = size.astype(np.uint64) * _ODD[0]
        rows, starts, left = slice(None), self.starts, size
        for _ in range(_LONG // 8):
            x = (h[rows] ^ (eight[starts] & _MASK[np.minimum(left, 8)])) * _MIX
            h[rows] = x ^ (x >> np.uint64(29))
            more = left > 8
            if not more.any():
                break
            rows = np.flatnonzero(more) if isinstance(rows, slice) else rows[more]
            starts, left = starts[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > _LONG).tolist():
            h[i] ^= np.uint64(xxhash.xxh64_intdigest(self.raw[self.starts[i] : self.ends[i]], 7))
        return h

    def anchors(self, window: int, group: int) -> np.ndarray:
        """Anchor of the window at each word (signed 64-bit); meaningless where a window leaves its text."""
        n = len(self.hashes)
        if n < window:
            return np.empty(0, np.int64)
        g = np.zeros(n - group + 1, dtype=np.uint64)
        for k in range(group):
            g += self.hashes[k : n - group + 1 + k] * _ODD[k]
        g ^= g >> np.uint64(29)
        g *= _MIX
        g ^= g >> np.uint64(32)
        # minimum over `width` neighbours by doubling
        width, have, m = window - group + 1, 1, g
        while have < width:
            step = min(have, width - have)
            m = np.minimum(m[:-step], m[step:])
            have += step
        return m.view(np.int64)


def _version(text: F.Column) -> F.Column:
    """60 bits of the SHA-256 of a text (null: of the empty one): which text a row holds."""
    return F.conv(F.substring(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256), 1, 15), 16, 10).cast("long")


def _batch(schema: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), schema)], [n for n, _ in schema])


def _texts(docs: DataFrame, window: int, group: int) -> DataFrame:
    """(doc_id, v, sha, n_words, anchors) of every row of ``docs(doc_id, t, v)``."""

    def run(batches):
        kind = [("sha", pa.binary()), ("n_words", pa.int64()), ("anchors", pa.list_(pa.int64()))]
        for b in batches:
            texts = text_bytes(b.column(1))
            words = Words(texts)
            m, first = words.anchors(window, group), words.first.tolist()
            rows = [
                (hashlib.sha256(t or b"").digest(), hi - lo, np.unique(m[lo : max(lo, hi - window + 1)])) for t, lo, hi in zip(texts, first, first[1:])
            ]
            if rows:
                found = _batch(kind, rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *found.columns], ["doc_id", "v", *found.schema.names])

    return docs.select("doc_id", "t", "v").mapInArrow(run, "doc_id long, v long, sha binary, n_words long, anchors array<long>")


_STRETCH = [("anchor", pa.int64()), ("salts", pa.int32()), ("doc_id", pa.int64()), ("v", pa.int64()), ("start", pa.int64()), ("text", pa.binary())]


def _stretches(joined: DataFrame, window: int, group: int, salt_rows: int) -> DataFrame:
    """Stretches of whole texts around recurring anchors: consecutive windows that share one anchor."""

    def run(batches):
        for b in batches:
            rows, texts = [], text_bytes(b.column(1))
            words = Words(texts)
            m, first, raw = words.anchors(window, group), words.first.tolist(), words.raw
            for d, v, wanted, lo, hi in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), first, first[1:]):
                known = {x["anchor"]: x["n"] for x in wanted}
                own = m[lo : max(lo, hi - window + 1)]
                at = np.flatnonzero(np.isin(own, np.fromiter(known, np.int64, len(known)), kind="sort"))
                if not len(at):
                    continue
                a = own[at]
                cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(a) != 0)) + 1
                begin, last = at[np.append(0, cuts)], at[np.append(cuts - 1, len(at) - 1)]
                spans = zip(begin.tolist(), own[begin].tolist(), words.starts[lo + begin].tolist(), words.ends[lo + last + window - 1].tolist())
                for s, anchor, x, y in spans:
                    rows.append((anchor, -(-known[anchor] // salt_rows), d, v, s, b" ".join(raw[x:y].split())))
                if len(rows) >= 20_000:
                    yield _batch(_STRETCH, rows)
                    rows = []
            if rows:
                yield _batch(_STRETCH, rows)

    return joined.mapInArrow(run, "anchor long, salts int, doc_id long, v long, start long, text binary")


_WINDOW = [("anchor", pa.int64()), ("salts", pa.int32()), ("text", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64())]


def _salted_windows(stretches: DataFrame, window: int) -> DataFrame:
    """(anchor, salts, text, lo): windows of salted anchors that occur in two or more documents, lo the smallest."""

    def run(batches):
        for b in batches:  # equal windows of a batch are merged before the shuffle
            seen: dict[tuple, list[int]] = {}
            for anchor, salts, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                words = text.split(b" ")
                for i in range(len(words) - window + 1):
                    known = seen.setdefault((anchor, salts, b" ".join(words[i : i + window])), [doc, doc])
                    known[0], known[1] = min(known[0], doc), max(known[1], doc)
            if seen:
                yield _batch(_WINDOW, [(*k, *v) for k, v in seen.items()])

    found = stretches.select("anchor", "salts", "doc_id", "text").mapInArrow(run, "anchor long, salts int, text binary, lo long, hi long")
    merged = found.groupBy("anchor", "salts", "text").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.where("lo < hi").select("anchor", "salts", "text", "lo")


class Shard:
    """Stretches of one shard: confirms windows, compiles them into an automaton and finds every occurrence.

    Each word is one character, so windows are strings of ``window`` characters and all comparisons are exact.
    """

    def __init__(self, window: int):
        self.window = window
        self.code: dict[bytes, str] = {}
        self.rows: dict[str, list[tuple[int, int, int]]] = {}  # line -> (doc_id, v, start) of its stretches
        self.lo: dict[str, int] = {}  # window -> smallest doc_id
        self.hi: dict[str, int] = {}  # window -> greatest doc_id

    def line(self, text: bytes) -> str:
        out, code = [], self.code
        for w in text.split(b" "):
            c = code.get(w)
            if c is None:
                k = len(code) + 1
                c = code[w] = chr(k if k < 0xD800 else k + 0x800)
            out.append(c)
        return "".join(out)

    def add_window(self, text: bytes, lo: int) -> None:
        """A window confirmed elsewhere, with its smallest doc_id."""
        w = self.line(text)
        self.lo[w], self.hi[w] = lo, lo + 1

    def add(self, text: bytes, doc: int, v: int, start: int) -> None:
        self.rows.setdefault(self.line(text), []).append((doc, v, start))

    def confirm(self) -> None:
        """Smallest and greatest doc_id of each window of the stretches added."""
        n, lo, hi = self.window, self.lo, self.hi
        for line, rows in self.rows.items():
            least, most = min(rows)[0], max(rows)[0]
            for i in range(len(line) - n + 1):
                w = line[i : i + n]
                if lo.get(w, least) >= least:
                    lo[w] = least
                if hi.get(w, most) <= most:
                    hi[w] = most

    def patterns(self) -> dict[str, int]:
        hi = self.hi
        return {w: least for w, least in self.lo.items() if least < hi[w]}

    def runs(self):
        """(doc_id, v, start, stop) of the words covered by windows that start in a smaller doc_id."""
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for w, least in self.patterns().items():
            machine.add_word(w, least)
        if not len(machine):
            return
        machine.make_automaton()
        n = self.window
        for line, rows in self.rows.items():
            hits = [(end - n + 1, least) for end, least in machine.iter(line)]
            if not hits:
                continue
            greatest = max(least for _, least in hits)
            whole = _joined([i for i, _ in hits], n)
            for doc, v, start in rows:
                for lo, hi in whole if doc > greatest else _joined([i for i, least in hits if least < doc], n):
                    yield doc, v, start + lo, start + hi


def _joined(starts: list[int], n: int) -> list[tuple[int, int]]:
    """Ranges of words covered by windows of ``n`` words at ascending starts."""
    out: list[tuple[int, int]] = []
    for i in starts:
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], i + n)
        else:
            out.append((i, i + n))
    return out


_RUN = [("doc_id", pa.int64()), ("v", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]
_CONFIRMED, _LOCATE, _BOTH = range(3)


def _located(stretches: DataFrame, window: int, shard_stretches: int) -> DataFrame:
    """(doc_id, v, start, stop): runs of words covered by windows that start in a smaller doc_id."""
    shards = max(1, -(-stretches.count() // shard_stretches))
    shard = F.expr(f"int(pmod(xxhash64(anchor, salt), {shards}))").alias("shard")
    none = F.lit(None).cast("long")
    dealt = stretches.withColumn("salt", F.expr("int(pmod(xxhash64(doc_id, v), salts))"))
    rows = dealt.select(shard, F.when(F.col("salts") > 1, _LOCATE).otherwise(_BOTH).alias("kind"), "text", "doc_id", "v", "start")
    salted = stretches.where("salts > 1")
    if not salted.isEmpty():
        windows = materialise(_salted_windows(salted, window), "salted_windows")
        windows = windows.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)")))
        rows = rows.unionByName(windows.select(shard, F.lit(_CONFIRMED).alias("kind"), "text", F.col("lo").alias("doc_id"), none.alias("v"), none.alias("start")))

    def run(batches):
        now, own, streamed = None, None, None

        def finish():
            # windows of salted anchors are confirmed already: only the others' stretches confirm theirs
            own.confirm()
            own.rows.update(streamed)
            return list(own.runs())

        for b in batches:
            for shard_, kind, text, doc, v, start in zip(*(c.to_pylist() for c in b.columns)):
                if shard_ != now:
                    if own is not None and (found := finish()):
                        yield _batch(_RUN, found)
                    now, own, streamed = shard_, Shard(window), {}
                if kind == _CONFIRMED:
                    own.add_window(text, doc)
                elif kind == _LOCATE:
                    streamed.setdefault(own.line(text), []).append((doc, v, start))
                else:
                    own.add(text, doc, v, start)
        if own is not None and (found := finish()):
            yield _batch(_RUN, found)

    rows = rows.select("shard", "kind", "text", "doc_id", "v", "start")
    # one shard a partition: neither a hash of shard numbers nor a merge of small partitions decides a task's size
    rows = rows.repartitionById(shards, F.col("shard"))
    return rows.mapInArrow(run, "doc_id long, v long, start long, stop long")


def repeated_runs(docs: DataFrame, window: int = WINDOW, group: int = GROUP, salt_rows: int = SALT_ROWS, shard_stretches: int = SHARD_STRETCHES) -> DataFrame:
    """``docs(doc_id long, t, v long)`` -> ``(doc_id, v, runs array<struct<start, stop>>)``, texts with removals only."""
    docs = docs.where("doc_id is not null")
    texts = materialise(_texts(docs, window, group), "texts")
    # copies: all but the smallest doc_id of a text go whole, if the text has a window at all
    first = texts.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = materialise(first.where("first < last").select("sha", "first"), "first")
    copies = texts.select("doc_id", "v", "sha", "n_words").join(first, "sha").where("doc_id > first")
    copies = materialise(copies.select("doc_id", "v", "n_words").distinct(), "copies")
    # anchors of two or more different texts
    anchors = texts.select("doc_id", "v", F.explode("anchors").alias("anchor"))
    several = anchors.groupBy("anchor").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("n"))
    several = materialise(several.where("a <> b").select("anchor", "n"), "several")
    rare = anchors.join(several, "anchor").join(copies.select("doc_id", "v"), ["doc_id", "v"], "left_anti")
    # repeated rows of one text list the same anchors
    per_text = rare.groupBy("doc_id", "v").agg(F.collect_set(F.struct("anchor", "n")).alias("wanted"))
    per_text = materialise(per_text, "anchors")
    joined = docs.join(per_text, ["doc_id", "v"]).select("doc_id", "t", "v", "wanted")
    stretches = materialise(_stretches(joined, window, group, salt_rows), "stretches")
    runs = _located(stretches, window, shard_stretches)
    whole = copies.where(F.col("n_words") >= window).select("doc_id", "v", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop"))
    found = runs.unionByName(whole).groupBy("doc_id", "v").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    return materialise(found, "runs")


def cut(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """The words outside the runs."""
    out, at = [], 0
    for s, e in sorted((r["start"], r["stop"]) for r in runs):
        if s > at:
            out += words[at:s]
        at = max(at, e)
    return out + words[at:]


OUT = ("n_words", "n_removed", "kept_text")


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, out: tuple = OUT, **kw) -> DataFrame:
    """All rows and columns of ``docs`` plus ``n_words long, n_removed long, kept_text string`` (names: ``out``;
    columns of ``docs`` with those names are replaced).

    kept_text joins the words left by single blanks; null texts have no words. Windows are judged on
    the input. A repeated doc_id never removes from itself; a row with a null doc_id removes nothing and loses
    nothing. Texts shorter than a window stay whole. An empty table gives an empty result.
    """
    docs = docs.drop(*out)
    rows, text_at = with_text(docs, text_col)
    names, text = docs.columns, rows.columns[text_at]
    version = _version(F.col(text))
    runs = repeated_runs(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t"), version.alias("v")), window=window, **kw)
    runs = runs.select(F.col("doc_id").alias("__id"), F.col("v").alias("__of"), F.col("runs").alias("__runs"))
    joined = rows.withColumn("__v", version).join(runs, (F.col(id_col).cast("long") == F.col("__id")) & (F.col("__v") == F.col("__of")), "left")
    joined = joined.select(*rows.columns, "__runs")
    schema = docs.select("*", F.lit(0).cast("long").alias(out[0]), F.lit(0).cast("long").alias(out[1]), F.lit("").alias(out[2])).schema
    runs_at = len(rows.columns)

    def run(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for t, r in zip(text_bytes(b.column(text_at)), b.column(runs_at).to_pylist()):
                words = (t or b"").split()
                left = cut(words, r) if r else words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(names)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*names, *out]
            )

    return joined.mapInArrow(run, schema)
