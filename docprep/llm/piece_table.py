"""SentencePiece ids through a merge-type prefix table, and texts back from ids.

A merge-type vocabulary joins the adjacent symbols whose joined piece has the best score
(ties: the leftmost) until no join is left. The result of a whole text is fixed by pairs:
a sequence of pieces is the text's encoding if and only if every piece encodes to itself and no
merge across the border of two neighbours comes before the merges inside them. So every
prefix has one last piece:

1. An Aho-Corasick automaton lists the pieces that end at each character.
2. Of these, the one that fits the last piece of the prefix before it (``PieceTable.fits``) is
   stored in the table.
3. The ids are recovered backwards from the end of the table.

A character that no piece holds is a border of its own and becomes its bytes. No piece holds a blank
after another character, so a text is cut before its runs of blanks and the table is filled stretch by stretch;
short stretches are remembered, bounded in bytes.
"""

from __future__ import annotations

from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

BLANK = "▁"
CACHE_BYTES = 96 * 1024 * 1024  # of stretches remembered; those of the round before stay beside them
FITTING = 250_000  # pairs of pieces remembered
LONGEST_KEPT = 64  # characters of a stretch that is remembered
_ENTRY_BYTES = 200  # of a remembered stretch besides its own characters and ids
_PROBE = "A  b ﬁ①éÅ "  # what a normalizer that changes characters would change
_INSTANCES: dict[str, "PieceTable"] = {}


def piece_table(model_path: str) -> "PieceTable":
    """One table per worker process and model file."""
    if model_path not in _INSTANCES:
        _INSTANCES[model_path] = PieceTable(model_path)
    return _INSTANCES[model_path]


class PieceTable(dict):
    """Stretch -> its ids as little-endian 32-bit integers.

    A key that does not begin with the blank mark stands for the stretch of one blank and itself;
    a key that begins with it stands for itself, and one that begins with a zero character for the rest of the key.
    """

    def __init__(self, model_path: str):
        super().__init__()
        lib = self.lib = SentencePieceProcessor(model_file=model_path)
        ids = {}
        score = {}
        for i in range(lib.vocab_size()):
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)):
                ids[lib.id_to_piece(i)], score[lib.id_to_piece(i)] = i, lib.get_score(i)
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not lib.is_byte(self.byte_ids[0]) or any(lib.is_unused(i) for i in ids.values()):
            raise ValueError(f"{model_path}: not a merge-type vocabulary with byte pieces")
        if any(BLANK in p.lstrip(BLANK) for p in ids):
            raise ValueError(f"{model_path}: pieces go on after a blank")
        if lib.normalize(_PROBE) != BLANK + _PROBE.replace(" ", BLANK):
            raise ValueError(f"{model_path}: its normalizer changes characters")
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        # place of a merge in the order of all merges; pieces of equal scores share one
        self.rank = {p: order[s] for p, s in score.items() if len(p) > 1}
        self.parts: dict[str, tuple[str, str]] = {}
        atoms = sorted({c for p in ids for c in p})
        self.entries = [*atoms, *(p for p in self.rank if self._derive(p))]  # what a prefix can end with
        self.entry_ids = [ids.get(p, -1) for p in self.entries]
        self.machine = ahocorasick.Automaton()
        for k, p in enumerate(self.entries):
            self.machine.add_word(p, (len(p), k))
        self.machine.make_automaton()
        self.fitting: dict[int, bool] = {}
        self.old: dict[str, bytes] = {}
        self.weight = 0
        self.line_feed = self._ids("\n")
        self.lone_feed = all("\n" not in p for p in ids)

    def _derive(self, piece: str) -> bool:
        """Store the two parts of the piece's last merge; False if its characters do not merge into it."""
        rank, parts = self.rank, list(piece)
        while len(parts) > 1:
            ranks = [rank.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [r for r in ranks if r is not None]
            if not known:
                return False
            k = ranks.index(min(known))
            last = parts[k : k + 2]
            parts[k : k + 2] = ["".join(last)]
        if max(rank.get(last[0], -1), rank.get(last[1], -1)) > rank[piece]:
            raise ValueError(f"piece {piece!r} is made before its parts")
        self.parts[piece] = last[0], last[1]
        return True

    def fits(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` stay neighbours: undo their merges from the last one and look for a
        merge across the border that would have come before the one undone."""
        rank = self.rank
        undone, right = None, False
        while True:
            r = rank.get(a + b)
            # of merges with equal scores the leftmost comes first: that of `a` lies left of the border, that of `b` right
            if r is not None and (undone is None or r < undone or (r == undone and right)):
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if rb >= ra:
                undone, right, b = rb, True, self.parts[b][0]
            else:
                undone, right, a = ra, False, self.parts[a][1]

    def _remember(self, pair: int, before: int, k: int) -> bool:
        good = self.fitting[pair] = self.fits(self.entries[before], self.entries[k])
        return good

    def _ids(self, stretch: str) -> bytes:
        # entry that the prefix up to each character ends with (-1: a character of no piece); the last place stands for the start
        last = [-1] * (len(stretch) + 1)
        known, width = self.fitting, len(self.entries)
        if len(known) > FITTING:
            known.clear()
        for end, (n, k) in self.machine.iter(stretch):
            if last[end] < 0:
                before = last[end - n]
                if before >= 0:
                    pair = before * width + k
                    if pair in known:
                        if not known[pair]:
                            continue
                    elif not self._remember(pair, before, k):
                        continue
                last[end] = k
        out = []
        at = len(stretch) - 1
        while at >= 0:
            k = last[at]
            i = self.entry_ids[k] if k >= 0 else -1
            if i < 0:
                out += [self.byte_ids[x] for x in reversed(stretch[at].encode())]
                at -= 1
            else:
                out.append(i)
                at -= len(self.entries[k])
        return array("i", out[::-1]).tobytes()

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is not None:
            return self._kept(key, found)
        if self.lone_feed and "\n" in key:  # a border: the lines one by one, those after the first without a blank
            lines = key.split("\n")
            return self._kept(key, self.line_feed.join([self[lines[0] or BLANK], *(self["\0" + x] if x else b"" for x in lines[1:])]))
        if key[0] == "\0":
            return self._kept(key, self._ids(key[1:]))
        return self._kept(key, self._ids(key if key[0] == BLANK else BLANK + key))

    def _kept(self, key: str, ids: bytes) -> bytes:
        if len(key) <= LONGEST_KEPT:
            self[key] = ids
            self.weight += _ENTRY_BYTES + len(key) + len(ids)
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null or empty: none)."""
        if not text:
            return b""
        if self.weight > CACHE_BYTES:
            self.old = dict(self)  # stretches of the last round come back when they are met again
            self.clear()
            self.weight = 0
        words = text.replace(BLANK, " ").split(" ")
        if "" in words or "\0" in text:
            words = self._runs(words)
        return b"".join(map(self.__getitem__, words))

    def _runs(self, words: list[str]) -> list[str]:
        """Keys of a text with several blanks in a row or at its ends."""
        out, run = [], ""
        for w in words:
            run += BLANK
            if w:
                out.append(w if run == BLANK and w[0] != "\0" else run + w)
                run = ""
        return [*out, run] if run else out


def encoded(
    docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, end: bool = True, decoded_col: str | None = None
) -> DataFrame:
    """The rows of ``docs`` with ``ids array<int>``: the whole text's ids as the library gives them, and the end id.

    ``keep`` names the columns that stay (default: all; one named like ``ids_col`` is replaced). Null and empty texts have the
    end id alone. Each row is a result of its own, repeated or not; an empty table gives an empty result. With ``decoded_col`` the text
    that the library's ``decode`` makes of the ids follows, in the same task.
    """
    new = [ids_col, decoded_col] if decoded_col else [ids_col]
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    src = docs.select(*names, F.col(text_col).cast("string").alias("__text"))
    types = src.select(*names, F.array(F.lit(0)).alias(ids_col), F.lit("").alias(decoded_col or "__text")).schema
    schema = T.StructType(types.fields[: len(names) + len(new)])

    def run(batches):
        table = piece_table(model_path)
        tail = array("i", [table.lib.eos_id()]).tobytes() if end else b""
        for b in batches:
            raw = [table.encode(t.as_py()) + tail for t in b.column(len(names))]
            stops = np.cumsum([0, *(len(r) // 4 for r in raw)])
            values = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"), pa.int32())
            columns = [*b.columns[: len(names)], pa.ListArray.from_arrays(pa.array(stops, pa.int32()), values)]
            if decoded_col:
                columns.append(pa.array([table.lib.decode(np.frombuffer(r, dtype="<i4").tolist()) for r in raw], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*names, *new])

    return src.mapInArrow(run, schema)


def decoded(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All rows and columns plus the text of their ids by the library's ``decode`` (null ids: null; a column named so is replaced)."""
    names = [c for c in rows.columns if c != text_col]
    src = rows.select(*names)
    at = names.index(ids_col)
    schema = src.select(*names, F.lit("").alias(text_col)).schema

    def run(batches):
        lib = SentencePieceProcessor(model_file=model_path)
        for b in batches:
            out = []
            for ids in b.column(at):  # a text's ids at a time are Python numbers
                ids = ids.as_py()
                out.append(None if ids is None else lib.decode(ids))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*names, text_col])

    return src.mapInArrow(run, schema)
