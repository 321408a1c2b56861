"""Outputs: Markdown tables on storage, per-batch bundles, batch envelopes.

Writes go through the DataFrame writer (atomic task commits: a lost executor
re-runs its tasks, it never leaves half a file behind). Bundles are built
per batch with ``applyInPandas``: a bundle holds at most 50 files (checked) of at
most 50 MB (admission).
"""

from __future__ import annotations

import hashlib
import io
import os
import uuid
import zipfile
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docprep.functions.names import ensure_md, safe_filename
from docprep.operators.admission import checked_rejected, error_message
from docprep.operators.names import unique_names
from docprep.session import spread

RESULT_FIELDS = [
    "original_filename",
    "format",
    "extension",
    "markdown_content",
    "markdown_filename",
    "anonymized",
    "original_chars",
    "compacted",
    "status",
]


def write_markdown(df: DataFrame, path: str, partition_by: str | None = "format", compression: str = "zstd", mode: str = "overwrite") -> None:
    """One row per document (name + Markdown) as parquet, optionally
    partitioned by format; ``compression`` is the writer's codec."""
    out = df.filter(F.col("status") == "success").select("batch_id", "ord", "markdown_filename", "markdown_content", "format")
    writer = out.write.mode(mode).option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def _file_system(folder: str):
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


# What write_blank_files writes at a time.
BLANKS = b" " * (1 << 20)


def write_blank_files(df: DataFrame, folder: str, path_col: str = "path", size_col: str = "length") -> int:
    """One file of ``size_col`` blanks per row below ``folder``, as ``write_files`` writes them, but no row carries the bytes.

    A task writes each size once, in pieces; on a local file system its other files of that size are hard links to it, so
    the disk holds one file a task and size. Where links are not to be had (other file systems, too many links) every file is written.
    """

    def run(batches):
        system, root = _file_system(folder)
        local = isinstance(system, fs.LocalFileSystem)
        written = {}
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target = f"{root}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                if not (local and size in written and _linked(written[size], part)):
                    with system.open_output_stream(part, compression=None) as out:
                        for lo in range(0, size, len(BLANKS)):
                            out.write(BLANKS[: size - lo])
                    written[size] = target
                system.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows = df.select(F.col(path_col).cast("string"), F.col(size_col).cast("long")).coalesce(df.sparkSession.sparkContext.defaultParallelism)
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _linked(source: str, target: str) -> bool:
    try:
        os.link(source, target)
        return True
    except OSError:
        return False


def write_files(df: DataFrame, folder: str, path_col: str = "path", content_col: str = "content") -> int:
    """One file per row below ``folder``: the bytes of ``content_col`` (null: none) under the relative path of ``path_col``.

    Tasks write the files themselves, under a name of their own attempt that is moved into place when the file is whole, so a task that
    runs again replaces its files. Returns the number of files. ``folder`` must be one that all executors share.
    """

    def run(batches):
        system, root = _file_system(folder)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target = f"{root}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part, compression=None) as out:
                    out.write(content or b"")
                system.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows = df.select(F.col(path_col).cast("string"), F.col(content_col).cast("binary"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_json(df: DataFrame, path: str, compression: str = "gzip", mode: str = "overwrite") -> None:
    """JSON lines, compressed (gzip by default)."""
    df.write.mode(mode).option("compression", compression).json(path)


def _write_streams(rows: DataFrame, order: list[str], folder: str, suffix: str, writer: Callable, grouped: bool = False) -> DataFrame:
    """One file per value of the first column: its other columns, row by row in ``order``, handed to ``writer(stream)``.

    A task holds one Arrow batch of rows and one open file, never a group. Files are written under a name of the attempt and moved
    into place when whole, so a task that runs again replaces its files. Returns the written manifest ``(group, path, n_rows)``.
    ``grouped``: the rows come from a window by the group, whose exchange is reused.
    """
    group, width = rows.columns[0], len(rows.columns) - len(order)
    kind = rows.schema[group].dataType

    def run(batches):
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        now = None  # (group, part file, stream, writer, rows)

        def close():
            key, part, stream, out, n = now
            out.close()
            stream.close()
            target = f"{root}/{'null' if key is None else 'is-' + quote(str(key), safe='')}{suffix}"
            system.move(part, target)
            return key, target.removeprefix(root + "/"), n

        done = []
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(width)]
            for key, *values in zip(*columns):
                if now is None or key != now[0]:
                    if now is not None:
                        done.append(close())
                    part = f"{root}/{uuid.uuid4().hex}.part"
                    stream = system.open_output_stream(part, compression=None)
                    now = key, part, stream, writer(stream), 0
                now[3].add(*values)
                now = *now[:4], now[4] + 1
            yield _manifest(done)
            done = []
        if now is not None:
            yield _manifest([close()])

    def _manifest(done):
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], arrow_kind), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], ["g", "path", "n_rows"])

    arrow_kind = to_arrow_type(kind)
    schema = StructType([StructField("g", kind), StructField("path", StringType()), StructField("n_rows", LongType())])
    sorted_rows = (rows if grouped else rows.repartition(F.col(group))).sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
    manifest = f"{folder}/_manifest"
    sorted_rows.mapInArrow(run, schema).write.mode("overwrite").parquet(manifest)
    return rows.sparkSession.read.parquet(manifest).withColumnRenamed("g", group)


def bundle_members(df: DataFrame, batch_col: str = "batch_id", ord_col: str = "ord", name_col: str = "markdown_filename") -> DataFrame:
    """Member names of each bundle: made safe, '.md'-suffixed, unique in the batch."""
    named = df.withColumn("__member", ensure_md(safe_filename(F.col(name_col))))
    return unique_names(named, batch_col, ord_col, "__member", "member_name").drop("__member")


def _zip_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("ord")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, content in zip(pdf["member_name"], pdf["markdown_content"]):
            zf.writestr(name, content or "")
    return pd.DataFrame({"batch_id": [pdf["batch_id"].iloc[0]], "n_files": [len(pdf)], "archive": [buf.getvalue()]})


def export_bundles(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """One deflate archive per batch of successful documents: ``(batch_id, n_files, archive, error)``.

    A batch of more than 50 documents is not bundled: its row has an error and no archive, and its
    texts never meet in one task. A batch without documents has no row.
    """
    ok = df.filter(F.col("status") == "success").select(batch_col, "ord", "markdown_filename", "markdown_content")
    rejected = checked_rejected(ok.select(batch_col, F.lit(0).cast("long").alias("length")), batch_col)
    members = bundle_members(ok.join(rejected, batch_col, "left_anti"), batch_col)
    id_type = df.schema[batch_col].dataType.simpleString()
    zipped = members.select(F.col(batch_col).alias("batch_id"), "ord", "member_name", "markdown_content").groupBy("batch_id").applyInPandas(
        _zip_group, f"batch_id {id_type}, n_files long, archive binary"
    )
    refused = rejected.select(F.col(batch_col).alias("batch_id"), error_message(F.col("__batch_code")).alias("error"))
    return zipped.withColumn("error", F.lit(None).cast("string")).unionByName(refused, allowMissingColumns=True)


class _ZipStream:
    """Members of one archive, deflated into a stream one after another."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)

    def add(self, name, content):
        # a fixed time: a task that runs again makes the same bytes
        info = zipfile.ZipInfo(name)
        info.compress_type = zipfile.ZIP_DEFLATED
        with self.zip.open(info, "w") as member:
            text = content or ""
            for lo in range(0, len(text), 1 << 20):
                member.write(text[lo : lo + (1 << 20)].encode())

    def close(self):
        self.zip.close()


def write_bundles(df: DataFrame, folder: str, batch_col: str = "batch_id") -> DataFrame:
    """S8 as files: one deflate archive per batch of successful documents below ``folder``, written member by member into a stream.

    Returns the manifest ``(batch, path, n_rows)``, path relative to ``folder``. No archive and no batch is ever whole in memory. As with
    ``export_bundles`` a batch of more than 50 documents has no archive; here it has no row either. Equal inputs give equal bytes.
    """
    ok = df.filter(F.col("status") == "success").select(batch_col, "ord", "markdown_filename", "markdown_content")
    rejected = checked_rejected(ok.select(batch_col, F.lit(0).cast("long").alias("length")), batch_col)
    members = bundle_members(ok.join(rejected, batch_col, "left_anti"), batch_col)
    return _write_streams(members.select(batch_col, "member_name", "markdown_content", "ord"), ["ord"], folder, ".zip", _ZipStream, grouped=True)


# Members that written_contents hands on at a time.
READ_MEMBERS = 10_000


def written_contents(manifest: DataFrame, folder: str) -> DataFrame:
    """``(batch_id, place, member, n_bytes, digest)`` of the archives named by the manifest of ``write_bundles``, read member by member.

    The manifest is small, so its rows are dealt to all cores whatever the number of its files.
    """
    group = manifest.columns[0]

    def contents(ids, held):
        rows, *columns = ([m[i] for m in held] for i in range(5))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
        values = [pa.array(v, kind) for v, kind in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *values], names)

    def run(batches):
        system, root = _file_system(folder)
        for b in batches:
            held = []
            for row, path in enumerate(b.column(1).to_pylist()):
                with system.open_input_file(f"{root}/{path}") as raw, zipfile.ZipFile(raw) as zf:
                    for place, info in enumerate(zf.infolist()):
                        digest = hashlib.md5()
                        with zf.open(info) as member:
                            while chunk := member.read(1 << 20):
                                digest.update(chunk)
                        held.append((row, place, info.filename, info.file_size, digest.hexdigest()))
                        if len(held) == READ_MEMBERS:
                            yield contents(b.column(0), held)
                            held = []
            yield contents(b.column(0), held)

    fields = (("place", "long"), ("member", "string"), ("n_bytes", "long"), ("digest", "string"))
    schema = StructType([StructField("batch_id", manifest.schema[group].dataType)])
    for name, kind in fields:
        schema = schema.add(name, kind)
    names = schema.names
    return spread(manifest.select(F.col(group).alias("g"), "path")).mapInArrow(run, schema)


def bundle_contents(bundles: DataFrame) -> DataFrame:
    """``(batch_id, place, member, n_bytes, digest)``: what the archives of ``export_bundles`` hold, a row per member in
    archive order, read back member by member (MD5 of the bytes). Refused batches have no archive and no rows."""
    id_type = bundles.schema["batch_id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            for batch, raw in zip(pdf["batch_id"], pdf["archive"]):
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as zf:
                    infos = zf.infolist()
                    digests = [hashlib.md5(zf.read(i)).hexdigest() for i in infos]
                yield pd.DataFrame(
                    {"batch_id": batch, "place": range(len(infos)), "member": [i.filename for i in infos], "n_bytes": [i.file_size for i in infos], "digest": digests}
                )

    found = bundles.where(F.col("archive").isNotNull()).select("batch_id", "archive")
    return found.mapInPandas(run, f"batch_id {id_type}, place long, member string, n_bytes long, digest string")


# Error codes that reject a whole batch (the request-level errors).
BATCH_LEVEL_CODES = ("TOO_MANY_FILES", "BATCH_TOO_LARGE")


def batch_envelope(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Per batch the results and errors (input order), counts and the JSON text.

    A batch rejected whole (too many files or bytes) has no envelope lists,
    like a request-level error: ``results``/``errors`` are NULL, ``batch_error``
    holds the message and the JSON is ``{"detail": ...}``. Lists are therefore
    only built for admitted batches, which admission bounds to 50 rows; a
    rejected batch of any size is reduced to counts by partial aggregation
    (``collect_list`` skips the NULLs it is given for such rows).
    """
    batch_level = F.coalesce(F.col("error_code").isin(*BATCH_LEVEL_CODES), F.lit(False))
    result = F.struct(*[F.col(c) for c in RESULT_FIELDS])
    error = F.struct(F.col("original_filename").alias("filename"), F.col("error"))
    staged = df.select(
        batch_col,
        F.when((F.col("status") == "success") & ~batch_level, F.struct(F.col("ord"), result.alias("r"))).alias("res"),
        F.when((F.col("status") == "error") & ~batch_level, F.struct(F.col("ord"), error.alias("e"))).alias("err"),
        F.when(batch_level, F.col("error")).alias("batch_err"),
        F.col("status"),
    )
    agg = staged.groupBy(batch_col).agg(
        F.array_sort(F.collect_list("res")).alias("res"),
        F.array_sort(F.collect_list("err")).alias("err"),
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.max("batch_err").alias("batch_error"),
    )
    admitted = F.col("batch_error").isNull()
    out = agg.select(
        batch_col,
        F.when(admitted, F.transform("res", lambda x: x["r"])).alias("results"),
        F.when(admitted, F.transform("err", lambda x: x["e"])).alias("errors"),
        "total_files",
        "successful",
        "failed",
        "batch_error",
    )
    body = F.to_json(F.struct("results", "errors", "total_files", "successful", "failed"))
    return out.withColumn("json", F.when(admitted, body).otherwise(F.to_json(F.struct(F.col("batch_error").alias("detail")))))


# Sections of an envelope in the order they are written.
SECTIONS = ("results", "errors", "counts", "detail")


def envelope_lines(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """S9 as rows: ``(batch, section, position, json)``, one row per result, per error and one per batch with its counts.

    Positions count from 0 in input order within a section. A batch rejected whole has one ``detail`` row, whatever its size. Texts stay one
    a row: no list of a batch is built, and rows of rejected batches never enter the window, so its partitions hold at most 50 rows.
    """
    batch_level = F.coalesce(F.col("error_code").isin(*BATCH_LEVEL_CODES), F.lit(False))
    good = F.col("status") == "success"
    result = F.to_json(F.struct(*RESULT_FIELDS))
    error = F.to_json(F.struct(F.col("original_filename").alias("filename"), "error"))
    section = F.when(good, F.lit("results")).otherwise(F.lit("errors"))
    place = Window.partitionBy(batch_col, "section").orderBy("ord")
    rows = df.where(~batch_level).select(batch_col, "ord", section.alias("section"), F.when(good, result).otherwise(error).alias("json"))
    rows = rows.withColumn("position", (F.row_number().over(place) - 1).cast("int")).select(batch_col, "section", "position", "json")
    totals = df.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.max(F.when(batch_level, F.col("error"))).alias("detail"),
    )
    counts, detail = F.to_json(F.struct("total_files", "successful", "failed")), F.to_json(F.struct("detail"))
    admitted = F.col("detail").isNull()
    ends = totals.select(
        batch_col,
        F.when(admitted, F.lit("counts")).otherwise(F.lit("detail")).alias("section"),
        F.lit(0).alias("position"),
        F.when(admitted, counts).otherwise(detail).alias("json"),
    )
    return rows.unionByName(ends)


class _EnvelopeStream:
    """The JSON text of one batch from its lines in order."""

    # what stands between the section before and this one
    BETWEEN = {
        ("", "results"): '{"results":[', ("results", "results"): ",",
        ("", "errors"): '{"results":[],"errors":[', ("results", "errors"): '],"errors":[', ("errors", "errors"): ",",
        ("", "counts"): '{"results":[],"errors":[],', ("results", "counts"): '],"errors":[],', ("errors", "counts"): "],",
        ("", "detail"): "",
    }

    def __init__(self, stream):
        self.stream, self.last = stream, ""

    def add(self, section, json):
        self.stream.write(self.BETWEEN[self.last, section].encode())
        self.stream.write((json[1:] if section == "counts" else json).encode())
        self.last = section

    def close(self):
        pass


def write_envelopes(df: DataFrame, folder: str, batch_col: str = "batch_id") -> DataFrame:
    """S9 as files: the JSON text of each batch below ``folder``, the same text as ``batch_envelope`` makes, written line by line.

    Returns the manifest ``(batch, path, n_rows)``, path relative to ``folder``.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    lines = envelope_lines(df, batch_col).select(batch_col, "section", "json", rank.alias("rank"), "position")
    return _write_streams(lines, ["rank", "position"], folder, ".json", _EnvelopeStream)
