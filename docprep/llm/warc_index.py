"""WARC archives with a two-level capture index.

Writing: each task streams its pages into one WARC file, one gzip member a
record; of equal payloads of at least ``min_bytes`` the one with the largest
page_id is the response, the others are revisits without a payload.

Index: capture rows are sorted by (reversed-host URL key, page_id) over range
partitions; each partition is one index file of zlib blocks of ``block_rows`` rows
and a directory file with the first key and byte range of each block. The top level
has one row a partition.

Lookup: keys are dealt to the partitions whose range holds them; a task
binary-searches the top level and the sparse directory, reads one block's byte
range, binary-searches the block and reads the record's byte range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.llm.common import lookup_bounded, materialise, new_file, scratch_path, store

MIN_BYTES = 1000
BLOCK_ROWS = 1024
MAX_PARTITIONS = 100_000
_DATE = "2024-01-01T00:00:00Z"  # the tables hold no capture times


def url_key(url):
    """Column: reversed-host key of a URL, ``com,example,www)/path?query`` (lower-case host, no
    scheme, user, fragment; null and host-less URLs keep what they have). Ports stay in the host."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages(page_id, url, payload)`` -> plus ``payload_bytes, digest, refers_to`` (null for responses).

    Only revisits travel in the deciding join; rows that hold the largest page_id of their
    payload are responses, and so are rows of a payload that has no page_id at all.
    """
    full = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    narrow = materialise(full.where(F.col("payload_bytes") >= min_bytes).select("page_id", "digest"), "digests")
    same = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    same = materialise(same.where("n > 1 and refers_to is not null").select("digest", "refers_to"), "same")
    # "split" lets the adaptive planner cut a digest that a third of the pages share
    revisits = narrow.join(same, "digest").where("not page_id <=> refers_to")
    revisits = materialise(revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct(), "revisits")
    return full.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")


def _header(*lines) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "replace")


def record(page_id, url, payload: bytes, digest: str, refers_to, refers_url="") -> bytes:
    """One gzip member holding one WARC record."""
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\n" + _header(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))) + b"\r\n"
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{page_id}:{sha}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}:{sha}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return gzip.compress(b"WARC/1.1\r\n" + _header(*head) + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _fields(raw: bytes) -> dict:
    return dict(line.split(": ", 1) for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)


def parse(member: bytes) -> dict:
    """Record -> page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    The payload of a response is checked against its digest and length."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = _fields(head)
    block = rest[: int(f["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda uri: None if (x := uri.split(":")[2]) == "None" else int(x)
    digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    n = int(_fields(http)["Content-Length"])
    kind = f["WARC-Type"]
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{f['WARC-Record-ID']}: the payload does not match its digest")
    return {
        "page_id": number(f["WARC-Record-ID"]),
        "url": f["WARC-Target-URI"],
        "payload": payload if kind == "response" else None,
        "payload_bytes": n,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(f["WARC-Refers-To"]) if kind == "revisit" else None,
    }


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages of ``decide`` as WARC files; returns the captures ``(key, page_id, file, offset, length)``."""

    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        name = f"{ctx.partitionId():06d}-{ctx.taskAttemptId():x}.warc.gz"  # an attempt writes a file of its own
        at = 0
        with new_file(f"{folder}/archives/{name}") as out:
            for b in batches:
                rows = []
                for key, page, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                    member = record(page, url, payload, digest, refers)
                    out.write(member)
                    rows.append((key, page, name, at, len(member)))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "offset", "length"])

    src = pages.select(url_key(F.col("url")).alias("key"), "page_id", "url", "payload", "digest", "refers_to")
    return materialise(src.mapInArrow(run, "key string, page_id long, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sort the captures into index files; returns the top level ``(first_key, first_page, file, rows)``."""
    spark = captures.sparkSession

    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        name = f"{ctx.partitionId():06d}-{ctx.taskAttemptId():x}"
        directory, rows, at, total, first = [], [], 0, 0, None
        with new_file(f"{folder}/index/{name}.blocks") as out:

            def flush():
                nonlocal at
                raw = zlib.compress(json.dumps(rows, separators=(",", ":")).encode(), 6)
                out.write(raw)
                directory.append([rows[0][0], rows[0][1], at, len(raw)])
                at += len(raw)

            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    r = [r[0], -(1 << 63) if r[1] is None else r[1], *r[2:]]
                    first = first or r
                    rows.append(r)
                    total += 1
                    if len(rows) == block_rows:
                        flush()
                        rows = []
            if rows:
                flush()
        if first:
            with new_file(f"{folder}/index/{name}.directory") as out:
                out.write(json.dumps(directory, separators=(",", ":")).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((first[0], pa.string()), (first[1], pa.int64()), (name, pa.string()), (total, pa.int64()))], ["first_key", "first_page", "file", "rows"])

    parts = max(2, min(MAX_PARTITIONS, -(-captures.count() // (64 * block_rows))))
    order = ["key", F.col("page_id").asc_nulls_first(), "file", "offset"]
    ranged = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "page_id", "file", "offset", "length")
    return materialise(ranged.mapInArrow(run, "first_key string, first_page long, file string, rows long"), "top")


class Index:
    """Reader of one task: the top level, one directory and one block are in memory at a time."""

    def __init__(self, folder: str, top: list):
        self.folder = folder
        self.top = sorted(top)
        self.name = self.block = None

    def _range(self, name: str, at: int, length: int) -> bytes:
        if name != getattr(self, "_open_name", None):
            system, path = store(f"{self.folder}/index/{name}.blocks")
            self._open, self._open_name = system.open_input_file(path), name
        return self._open.read_at(length, at)

    def _load(self, name: str) -> None:
        system, path = store(f"{self.folder}/index/{name}.directory")
        with system.open_input_stream(path) as f:
            self.directory = [((k, p), at, n) for k, p, at, n in json.loads(f.read())]
        self.name, self.block = name, None

    def _rows(self, i: int) -> list:
        if self.block != (self.name, i):
            _, at, n = self.directory[i]
            self.rows = json.loads(zlib.decompress(self._range(self.name, at, n)))
            self.keys = [(r[0], r[1]) for r in self.rows]
            self.block = (self.name, i)
        return self.rows

    def find(self, key: str, page: int):
        """All captures of (key, page): from the first row at or after it on, over block and file borders."""
        want = (key, page)
        t = max(0, bisect_right(self.top, (key, page, "")) - 1)
        while t < len(self.top):
            if self.top[t][:2] > want:
                return
            if self.name != self.top[t][2]:
                self._load(self.top[t][2])
            i = max(0, bisect_right(self.directory, want, key=lambda d: d[0]) - 1)
            while i > 0 and self.directory[i][0] == want:  # equal rows may begin in an earlier block
                i -= 1
            while i < len(self.directory) and self.directory[i][0] <= want:
                rows = self._rows(i)
                hi = bisect_right(self.keys, want)
                lo = hi
                while lo > 0 and self.keys[lo - 1] == want:
                    lo -= 1
                yield from rows[lo:hi]
                i += 1
            t += 1


def lookup(spark: SparkSession, folder: str, top: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of the captures named by ``wanted(key, page_id)``, read back through both index levels."""
    shards = lookup_bounded(top, MAX_PARTITIONS, "index partitions")  # one row an index file
    shards = sorted((r.first_key, r.first_page, r.file) for r in shards)

    def run(batches):
        index, opened, handle = Index(folder, shards), None, None
        for b in batches:
            rows = []
            for key, page in zip(*(c.to_pylist() for c in b.columns)):
                for _, _, name, at, length in index.find(key, -(1 << 63) if page is None else page):
                    if opened != name:
                        system, path = store(f"{folder}/archives/{name}")
                        handle, opened = system.open_input_file(path), name
                    r = parse(handle.read_at(length, at))
                    rows.append((r["page_id"], r["url"], r["payload"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
                if len(rows) >= 256:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [f.split()[0] for f in schema.split(", ")]
    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return wanted.select("key", "page_id").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES):
    """Write archives and index of all pages; returns ``(folder, top level)``.

    Null html is an empty payload; null URLs index under the key ``)``; a null page_id
    is written as none. Repeated rows are records of their own. Extra columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    src = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"").cast("binary")).alias("payload"),
    )
    captures = write_archives(decide(src, min_bytes), folder)
    return folder, write_index(captures, folder)


def read_back(pages: DataFrame, folder: str, top: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every page's records through the index: distinct keys, sorted so that neighbours share blocks."""
    wanted = pages.select(url_key(F.col(url_col).cast("string")).alias("key"), F.col(id_col).cast("long").alias("page_id")).distinct()
    shards = max(1, top.count())
    wanted = wanted.repartitionByRange(shards, "key", F.col("page_id").asc_nulls_first()).sortWithinPartitions("key", F.col("page_id").asc_nulls_first())
    return lookup(pages.sparkSession, folder, top, wanted)
