"""Shared helpers of the training-data operators.

* ``materialise`` cuts lineage with a Parquet table in the shared folder that
  the cluster names in ``spark.checkpoint.dir``: a lost executor costs only the
  step that runs, earlier steps are read back from the table.
* ``lookup_bounded`` collects a table whose size is bounded by a parameter and
  fails loudly when the bound does not hold.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.session import checkpoint_dir

# While a step is written: free its shuffle files at its end (the step's table
# replaces them) and hand Python workers batches of bounded size in bytes.
_STEP_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


@contextmanager
def step_conf(spark: SparkSession):
    """Set the step settings for one action and restore the session's own values."""
    before = {k: spark.conf.get(k, None) for k in _STEP_CONF}
    for k, v in _STEP_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a table scan."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with step_conf(spark):
        # row groups of a size that a task can hold beside its workers
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 32 * 1024 * 1024).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The values of a column of strings or bytes as bytes; strings are not copied for it."""
    kind = column.type
    if pa.types.is_string(kind):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(kind):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def with_text(docs: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """(rows, place of their text): the column itself where it holds strings or bytes, else a copy of it as a string, last."""
    if docs.schema[text_col].dataType.simpleString() in ("string", "binary"):
        return docs, docs.columns.index(text_col)
    return docs.withColumn("__text", F.col(text_col).cast("string")), len(docs.columns)


def store(uri: str):
    """(pyarrow file system, path) of a folder or file; a URI without a scheme is a plain path."""
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        uri = uri[5:]
    return fs.LocalFileSystem(), uri


@contextmanager
def new_file(uri: str):
    """Write a file under a name of this attempt and move it into place when whole:
    a task that is lost or repeated never leaves a part under the final name."""
    system, path = store(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as out:
        yield out
    system.move(part, path)


def lookup_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a table that must not exceed ``max_rows`` (checked, never cut)."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; raise the parameter or split the input")
    return rows
