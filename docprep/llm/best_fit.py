"""Bounded-space online best-fit packing of tokenised documents into sequences.

Texts become pieces of at most ``capacity`` ids inside the scan's tasks; ids leave
a task only as the piece's own column. Packing needs the lengths alone: pieces
are dealt by a hash of (doc_id, piece) into groups of ``group_pieces`` and stream
through a packer that keeps at most ``open_bins`` sequences open. The bitset has
a bit per free size that some open sequence has; the best fit is the lowest set
bit at or above the piece's length. When a new sequence would exceed the limit,
the fullest open one closes first.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.llm.common import materialise
from docprep.llm.encoder import encoder

CAPACITY = 2048
OPEN_BINS = 1024
GROUP_PIECES = 100_000
END_ID = 0


def tokenised_pieces(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, special_as_text: bool = False, crc_only: bool = False
) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: whole texts as ids plus the end id, cut only beyond ``capacity``.

    All pieces but the first are full; ids are little-endian unsigned 32-bit
    integers. Null text counts as empty: one piece holding the end id. A special token's
    string in a text becomes its id, as the library does, unless ``special_as_text``. With ``crc_only`` the column
    ``ids_crc32 long`` (CRC-32 of the ids, unsigned) stands in place of ``ids``. Repeated rows give repeated pieces, an
    empty table none; other columns are left out.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    last, kind = ("ids_crc32", pa.int64()) if crc_only else ("ids", pa.binary())

    def run(batches):
        enc = encoder(tokenizer_path, special_as_text)
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                rows = []
                for d, raw in zip(doc_ids[lo : lo + 256], enc.encode(texts[lo : lo + 256])):
                    raw += end
                    n = len(raw) // 4
                    first = (n - 1) % capacity + 1
                    at, k = 0, 0
                    while at < n:
                        stop = first if k == 0 else at + capacity
                        ids = raw[4 * at : 4 * stop]
                        rows.append((d, k, at, stop - at, zlib.crc32(ids) if crc_only else ids))
                        at, k = stop, k + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), kind))],
                    ["doc_id", "piece", "start", "length", last],
                )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id long, piece int, start long, length long, {last} {'long' if crc_only else 'binary'}")


class BestFit:
    """Online packer: ``put(length)`` gives (sequence number, offset) at once."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free_sizes = 0  # bit f set: some open sequence has f ids free
        self.bins: list[deque[int]] = [deque() for _ in range(capacity + 1)]
        self.n_open = self.n = 0

    def _take(self, free: int) -> int:
        seq = self.bins[free].popleft()
        if not self.bins[free]:
            self.free_sizes ^= 1 << free
        return seq

    def put(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"length {length} is outside 1 to {self.capacity}")
        fits = self.free_sizes >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            seq = self._take(free)
        else:
            free, seq = self.capacity, self.n
            self.n += 1
            if length < self.capacity:
                if self.n_open == self.open_bins:
                    fullest = (self.free_sizes & -self.free_sizes).bit_length() - 1
                    self._take(fullest)
                    self.n_open -= 1
                self.n_open += 1
        left = free - length
        if left:
            self.free_sizes |= 1 << left
            self.bins[left].append(seq)
        elif free < self.capacity:
            self.n_open -= 1
        return seq, self.capacity - free


def pack_stream(lengths: Iterable[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    packer = BestFit(capacity, open_bins)
    return map(packer.put, lengths)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces(doc_id, piece, length, ...)`` -> the same columns plus ``sequence_id`` and ``offset``.

    A sequence holds at most ``capacity`` ids and its offsets have no gaps. Rows
    are dealt by hash, so neither a hot document nor an order of the input
    decides a group's size; equal rows are packed one by one. Columns named like the two new ones are
    replaced, other columns stay. An empty table gives an empty result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    pieces = materialise(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # repeated rows of one document differ by their position and are dealt out evenly too
    dealt = pieces.withColumn("__at", F.monotonically_increasing_id())
    dealt = dealt.withColumn("__h", F.xxhash64("doc_id", "piece", "__at"))
    dealt = dealt.withColumn("__g", F.expr(f"pmod(__h, {groups})"))
    at = names.index("length")
    schema = pieces.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches):
        group, packer = None, None
        for b in batches:
            g = b.column(len(names)).to_pylist()
            seqs, offsets = [], []
            for k, length in zip(g, b.column(at).to_pylist()):
                if k != group:
                    group, packer = k, BestFit(capacity, open_bins)
                s, o = packer.put(length)
                seqs.append((k << 40) + s)
                offsets.append(o)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(names)], pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"]
            )

    dealt = dealt.repartition(groups, "__g").sortWithinPartitions("__g", "__h")
    return dealt.select(*names, "__g").mapInArrow(run, schema)
