"""Words and runs of words of many texts at once, as arrays (the per-task part of D12).

Texts are taken as arrays of code points. A table of the word characters, made by Spark's own regex and ``lower``,
gives every character a code (0: not in a word) that is the same for all cases of a letter. A run of words is known by
a polynomial hash of its codes, read from prefix sums, so a run of any length costs the same. Runs with one key have
one hash; different keys may share one, so a hash only ever proposes a run and Spark's comparison of the keys decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Code points put into one set of arrays; a longer text is cut where no run can go on.
CHUNK = 1 << 19
# Between two of these characters, none of which is in a word, a text may be cut: words there are not next to each other.
_BREAK = re.compile("[\\t\\n\\r !-/:-@]{2}")
_APART = "\n\n"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX, _WHOLE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_word_codes: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def word_codes(spark: SparkSession, rx: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters that ``rx`` takes as parts of a word and their codes, one pass over all code points, kept for the process."""
    if rx not in _word_codes:
        points = spark.range(0x110000).where("id < 55296 or id > 57343")
        chars = points.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
        words = chars.where(F.col("c").rlike(f"^{rx}$")).withColumn("l", F.lower("c"))
        # a letter whose lower case is more than one character keeps its own code
        code = F.when(F.length("l") == 1, F.ascii("l")).otherwise(F.col("id")).cast("int")
        row = words.agg(F.collect_list(F.col("id").cast("int")).alias("at"), F.collect_list(code).alias("code")).first()
        at, codes = np.array(row["at"], np.int32), np.array(row["code"], np.int32)
        codes[codes == 0x3C2] = 0x3C3  # which of the two small sigmas depends on the letters around it
        _word_codes[rx] = at, codes
    return _word_codes[rx]


def probes(h: np.ndarray, whole: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a filter of ``bits`` for the hash of a prefix, or of a ``whole`` term."""
    h = h ^ _WHOLE if whole else h
    h = (h ^ (h >> np.uint64(33))) * _MIX
    h ^= h >> np.uint64(29)
    low = np.uint64(bits - 1)
    return h & low, (h >> np.uint64(32)) & low


class Words:
    """The words of several texts: where each begins and ends, and the hash of any run of them."""

    def __init__(self, joined: str, kit: WordKit):
        codes = kit.code[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
        edges = np.flatnonzero(np.diff(codes != 0, prepend=False, append=False))
        self.begin, self.end = edges[::2], edges[1::2]
        power, self.inverse = kit.powers(len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * power, out=self.sums[1:])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        a = self.begin[first]
        return (self.sums[self.end[last]] - self.sums[a]) * self.inverse[a]

    def runs(self, longest: int, bits: int, filter_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of the runs that pass the filter as whole terms; a run grows while it passes as a prefix."""

        def passes(h: np.ndarray, whole: bool) -> np.ndarray:
            x, y = probes(h, whole, bits)
            return filter_bits[x] & filter_bits[y]

        live, firsts, sizes = np.arange(len(self.begin)), [], []
        for n in range(1, longest + 1):
            live = live[: np.searchsorted(live, len(self.begin) - n + 1)]
            if n > 1:
                live = live[self.begin[live + n - 1] == self.end[live + n - 2] + 1]
            if not len(live):
                break
            h = self.hashes(live, live + n - 1)
            prefix = passes(h, False)
            live, h = live[prefix], h[prefix]
            found = live[passes(h, True)]
            firsts.append(found)
            sizes.append(np.full(len(found), n, np.int32))
        if not firsts:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(firsts), np.concatenate(sizes)


class WordKit:
    """What a task needs to find words: the code of every character, and the powers of the hash as far as they are used."""

    def __init__(self, codes: tuple[np.ndarray, np.ndarray]):
        self.code = np.zeros(0x110000, np.uint64)
        self.code[codes[0]] = codes[1]
        self.power = self.inverse = np.zeros(0, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            self.power, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, p, np.uint64)), dtype=np.uint64) for p in (_BASE, _INVERSE))
        return self.power[:n], self.inverse

    def chunks(self, texts: list[str | None]) -> Iterator[tuple[Words, str, np.ndarray, np.ndarray, np.ndarray]]:
        """Of about ``CHUNK`` code points each: the words, the joined text, and of each piece in it the place, the row and the place in its row's text."""
        held, size = [], 0
        for row, text in enumerate(texts):
            for start, piece in _pieces(text or ""):
                if held and size + len(piece) > CHUNK:
                    yield self._chunk(held)
                    held, size = [], 0
                held.append((row, start, piece))
                size += len(piece) + len(_APART)
        if held:
            yield self._chunk(held)

    def _chunk(self, held):
        joined = _APART.join(piece for _, _, piece in held)
        places = np.cumsum([0] + [len(piece) + len(_APART) for _, _, piece in held[:-1]])
        return Words(joined, self), joined, places, np.array([row for row, _, _ in held]), np.array([start for _, start, _ in held])


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    lo = 0
    while len(text) - lo > CHUNK and (at := _BREAK.search(text, lo + CHUNK // 2)):
        yield lo, text[lo : at.start() + 1]
        lo = at.start() + 1
    if lo < len(text):
        yield lo, text[lo:] if lo else text
