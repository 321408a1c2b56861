"""Token ids in frequency rank order, byte-aligned variable-length, control bytes apart.

Writing: texts become ids once, sorted by doc_id into a scratch table; ids are
counted over all documents and ranked (most frequent first, ties by id), so the
frequent ids take one byte. Each task cuts its rows into segment files of bounded
size. A segment holds, in this order: magic, numbers of documents and ids,
doc_ids, ids per document, control bytes (two bits an id: bytes - 1, four ids a
byte), data bytes. The manifest table lists the segments in ascending doc_id order;
``ranks`` (one file) maps a rank back to its id.

Reading: the control bytes index a numpy table of lengths; running sums of the
lengths place every id, and the bytes of equal-length ids are gathered at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docprep.llm.common import lookup_bounded, materialise, new_file, scratch_path, store
from docprep.llm.encoder import encoder

END_ID = 1
MAGIC = b"RVB1"
SEGMENT_IDS = 8_000_000
BUCKET_BYTES = 64 * 1024 * 1024
MAX_VOCABULARY = 4_000_000
# lengths of the four ids of each control byte
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Ranks (unsigned 32-bit) -> (control bytes, data bytes)."""
    r = ranks.astype("<u4")
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, dtype=np.uint8)
    padded[: len(r)] = size - 1
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    keep = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.astype(np.uint8).tobytes(), r.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def segment_bytes(doc_ids: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    head = np.array([len(doc_ids), len(ranks)], dtype="<i8").tobytes()
    return b"".join([MAGIC, head, doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), control, data])


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment -> (doc_ids, ids per document, ranks)."""
    if raw[:4] != MAGIC:
        raise ValueError("not a segment of this format")
    docs, n = (int(x) for x in np.frombuffer(raw, "<i8", 2, 4))
    at = 20
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    counts = np.frombuffer(raw, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at)
    data = np.frombuffer(raw, np.uint8, -1, at + len(control)) if len(raw) > at + len(control) else np.empty(0, np.uint8)
    return doc_ids, counts, decode_ranks(control, data, n)


def _tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, special_as_text: bool) -> DataFrame:
    """(bucket, doc_id, n, ids) sorted by doc_id within buckets of consecutive doc_ids, as a written table."""
    size = docs.agg(F.count("doc_id").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()[0]
    spark = docs.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, -(-(size.b or 0) // BUCKET_BYTES))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 10 * buckets)).alias("q")).collect()[0].q or []
    bounds = np.array(sorted(set(bounds)), dtype=np.int64)  # one number a bucket
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer_path, special_as_text)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                part = ids[lo : lo + 256]
                raw = [r + end for r in enc.encode(texts[lo : lo + 256])]
                bucket = np.searchsorted(bounds, np.array([-(1 << 63) if d is None else d for d in part], dtype=np.int64))
                # two bytes an id where they do, to halve what is sorted
                small = [np.frombuffer(r, "<u4") for r in raw]
                packed = [x.astype("<u2").tobytes() if x.max() < 65_536 else r for x, r in zip(small, raw)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int32()), pa.array(part, pa.int64()), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array(packed, pa.binary())],
                    ["bucket", "doc_id", "n", "ids"],
                )

    found = docs.mapInArrow(run, "bucket int, doc_id long, n long, ids binary")
    found = found.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first())
    return materialise(found, "ids")


def _ids_of(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _ranks(ids: DataFrame) -> np.ndarray:
    """id of each rank: all ids of the corpus by falling count, ties by id."""

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            raws, sizes = b.column(1).to_pylist(), b.column(0).to_pylist()
            for width, code in ((2, "<u2"), (4, "<u4")):  # a text has an end id at least
                c = np.bincount(np.frombuffer(b"".join(r for r, n in zip(raws, sizes) if len(r) == width * n), code))
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[: len(c)] += c
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    counts = ids.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = lookup_bounded(counts, MAX_VOCABULARY, "vocabulary")  # a row an id of the vocabulary
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))], dtype="<u4")


def write_corpus(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, text_col: str = "text", id_col: str = "doc_id", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, special_as_text: bool = False
) -> str:
    """Encode whole texts and write the corpus below ``folder`` (default: the shared folder); returns the folder.

    Null texts count as empty (the end id alone); null doc_ids come first; rows of
    one doc_id stay rows of their own. A special token's string in a text becomes its id, as the library
    does, unless ``special_as_text``. An empty table gives a corpus without segments.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "corpus")
    ids = _tokenised(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), tokenizer_path, end_id, special_as_text)
    id_of_rank = _ranks(ids)
    with new_file(f"{folder}/ranks") as out:
        out.write(id_of_rank.tobytes())
    rank_of_id = np.zeros(int(id_of_rank.max(initial=0)) + 1, dtype="<u4")
    rank_of_id[id_of_rank] = np.arange(len(id_of_rank), dtype="<u4")
    table = spark.sparkContext.broadcast(rank_of_id)  # four bytes an id of the vocabulary

    def write(batches):
        rank_of, bucket, rows, size, part = table.value, None, [], 0, 0

        def flush():
            docs_ = np.array([-(1 << 63) if r[0] is None else r[0] for r in rows], dtype=np.int64)
            counts = np.array([r[1] for r in rows], dtype=np.int64)
            raw = segment_bytes(docs_, counts, rank_of[np.concatenate([r[2] for r in rows])])
            name = f"{bucket:07d}-{int(docs_[0]) & 0xFFFFFFFFFFFFFFFF:016x}-{zlib.crc32(raw):08x}-{part}.seg"
            with new_file(f"{folder}/segments/{name}") as out:
                out.write(raw)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((name, pa.string()), (bucket, pa.int32()), (int(docs_[0]), pa.int64()), (int(docs_[-1]), pa.int64()), (len(docs_), pa.int64()), (int(counts.sum()), pa.int64()))],
                ["name", "bucket", "first_doc", "last_doc", "n_docs", "n_ids"],
            )

        for b in batches:
            for k, d, n, raw in zip(*(b.column(c).to_pylist() for c in range(4))):
                if rows and (k != bucket or size >= segment_ids):
                    yield flush()
                    rows, size, part = [], 0, part + 1
                bucket = k
                rows.append((d, n, _ids_of(raw, n)))
                size += n
        if rows:
            yield flush()

    schema = "name string, bucket int, first_doc long, last_doc long, n_docs long, n_ids long"
    manifest = materialise(ids.mapInArrow(write, schema), "manifest")
    order = Window.orderBy("first_doc", "last_doc", "name").rowsBetween(Window.unboundedPreceding, -1)  # one row a segment
    manifest = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder


MANIFEST = "name string, bucket int, first_doc long, last_doc long, n_docs long, n_ids long, start long"


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` decoded from the files; ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        system, path = store(f"{folder}/ranks")
        with system.open_input_stream(path) as f:
            id_of_rank = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, path = store(f"{folder}/segments/{name}")
                with system.open_input_stream(path, compression=None) as f:
                    doc_ids, counts, ranks = read_segment(f.read())
                ids = id_of_rank[ranks]
                ends = np.cumsum(counts)
                for lo in range(0, len(doc_ids), 512):
                    hi = min(lo + 512, len(doc_ids))
                    begin = ends[lo:hi] - counts[lo:hi]
                    own = doc_ids[lo:hi]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int64(), mask=own == -(1 << 63)),
                            pa.array(begin + start, pa.int64()),
                            pa.array(counts[lo:hi], pa.int64()),
                            pa.array([ids[x:y].tobytes() for x, y in zip(begin, ends[lo:hi])], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("name", "start")
    tasks = max(1, manifest.count())
    return manifest.repartition(tasks, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
