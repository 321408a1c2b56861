"""Inputs: files on storage (S1) and text already in tables."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from docprep.functions.names import extension


def read_files(
    spark: SparkSession,
    path: str,
    glob: str | None = None,
    recursive: bool = True,
    with_content: bool = True,
    listing: str | None = None,
) -> DataFrame:
    """One row per file: ``path, filename, length, modificationTime[, content]``.

    ``glob`` narrows the listing at scan time (``pathGlobFilter``). Without
    ``content`` the bytes are never read; size filters on ``length`` are pushed
    into the scan, so rejected files are not read either.

    Spark's scan keeps every file on the driver (about 4 KB each). For many files ``listing`` names a new folder that all
    executors share: they list the folder ``path`` themselves and write what they find there, so the driver holds none of it. Nothing is
    pushed into such a read: leave ``content`` out, narrow the rows, then add it by ``read_content``, as ``prepare`` does.
    """
    if listing is not None:
        files = list_files(spark, path, listing, glob, recursive)
        return read_content(files) if with_content else files
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    cols = [
        "path",
        F.element_at(F.split("path", "/", -1), -1).alias("filename"),
        "length",
        "modificationTime",
    ]
    if with_content:
        cols.append("content")
    return df.select(*cols).withColumn("ext", extension(F.col("filename")))


def _located(path: str, systems: dict):
    """The file system of a path of ``read_files`` and the path in it; ``systems`` keeps those met."""
    scheme, remote, rest = path.partition("://")
    if path.startswith("file:") or not remote:
        return systems.setdefault("file", (fs.LocalFileSystem(), ""))[0], path.removeprefix("file:")
    host, _, inner = rest.partition("/")
    root = f"{scheme}://{host}/"
    if root not in systems:
        systems[root] = fs.FileSystem.from_uri(root)
    system, base = systems[root]
    return system, f"{base.rstrip('/')}/{inner}"


def _entries(system, folder: str):
    """``(name, is a folder, length, modification time in ms)`` of what a folder holds; a local folder's are never in memory together."""
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder)):
            yield info.base_name, info.type == fs.FileType.Directory, info.size, None if info.mtime_ns is None else info.mtime_ns // 1_000_000
        return
    with os.scandir(folder) as found:
        for entry in found:
            try:
                stat = entry.stat()
            except FileNotFoundError:  # gone meanwhile
                continue
            yield entry.name, entry.is_dir(), stat.st_size, stat.st_mtime_ns // 1_000_000


def _hidden(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


# Rows that a listing task hands on at a time; bytes of files that a frame holds (and one file more); bytes of files that a task reads.
LISTED_ROWS = 10_000
FRAME_BYTES = 8 << 20
TASK_BYTES = 64 << 20


def list_files(spark: SparkSession, path: str, listing: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """The rows of ``read_files`` without ``content`` for the files below the folder ``path``, listed by the executors.

    A job a level of folders: its folders are dealt to all cores, and what they hold is written as Parquet below ``listing``, from where
    the next level and the rows are read. As with Spark's sources, empty files and hidden names have no row. pyarrow must know the file
    system of ``path``. Not ``recursive``: the folder's own files.
    """
    local = path.startswith("file:") or "://" not in path
    root = f"file:{os.path.abspath(path.removeprefix('file:'))}" if local else path

    def run(batches):
        systems = {}

        def frame(rows):
            paths, *others = zip(*rows)
            kinds = (pa.bool_(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array(v, k) for v, k in zip(others, kinds))], ["path", "folder", "length", "ms"])

        for b in batches:
            rows = []
            for folder in b.column(0).to_pylist():
                for name, inner, length, ms in _entries(*_located(folder, systems)):
                    if not _hidden(name) and (inner or length):
                        rows.append((f"{folder.rstrip('/')}/{name}", inner, length, ms))
                    if len(rows) == LISTED_ROWS:
                        yield frame(rows)
                        rows = []
            if rows:
                yield frame(rows)

    folders, levels = spark.range(1, numPartitions=1).select(F.lit(root).alias("path")), []
    while True:
        levels.append(f"{listing.rstrip('/')}/{len(levels)}")
        folders.mapInArrow(run, "path string, folder boolean, length long, ms long").write.mode("overwrite").parquet(levels[-1])
        found = spark.read.parquet(levels[-1]).where("folder").select("path")
        if not recursive or found.isEmpty():
            break
        folders = found.repartition(spark.sparkContext.defaultParallelism)
    files = spark.read.parquet(*levels).where("NOT folder")
    filename = F.element_at(F.split("path", "/", -1), -1)
    if glob:  # by Hadoop's own pattern, as pathGlobFilter
        pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
        files = files.where(filename.rlike(f"(?s)\\A(?:{pattern})\\z"))
    files = files.select("path", filename.alias("filename"), "length", F.timestamp_millis("ms").alias("modificationTime"))
    return files.withColumn("ext", extension(F.col("filename")))


def read_content(files: DataFrame, content_col: str = "content", max_size: int | None = None) -> DataFrame:
    """Rows with ``path`` and ``length`` (``read_files``) with the bytes of their files; null, and nothing read, for files over ``max_size``.

    The narrow rows are dealt to tasks of about ``TASK_BYTES`` before any bytes are read. A task holds ``FRAME_BYTES`` and one file.
    """
    size = F.col("length") if max_size is None else F.when(F.col("length") <= max_size, F.col("length"))
    total = files.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    path_at, length_at = files.columns.index("path"), files.columns.index("length")

    def run(batches):
        systems = {}

        def content(path):
            system, inner = _located(path, systems)
            with system.open_input_file(inner) as raw:
                return raw.read()

        for b in batches:
            start, held, n_bytes = 0, [], 0
            for path, length in zip(b.column(path_at).to_pylist(), b.column(length_at).to_pylist()):
                over = max_size is not None and length is not None and length > max_size
                held.append(None if over else content(path))
                n_bytes += len(held[-1] or b"")
                if n_bytes >= FRAME_BYTES:
                    yield framed(b, start, held)
                    start, held, n_bytes = start + len(held), [], 0
            if held:
                yield framed(b, start, held)

    def framed(b, start, held):
        return pa.RecordBatch.from_arrays([*b.slice(start, len(held)).columns, pa.array(held, pa.large_binary())], names)

    schema = StructType([*files.schema.fields, StructField(content_col, BinaryType())])
    names = schema.names
    return files.repartition(tasks).mapInArrow(run, schema)


def read_corpus(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """A table whose text is already extracted (parquet)."""
    df = spark.read.parquet(path)
    if text_col not in df.columns:
        raise ValueError(f"column {text_col!r} not in {df.columns}")
    return df
