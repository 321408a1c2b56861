"""The pipeline over Structured Streaming (ST1-ST3).

* ST1 ``prepare_stream``: arriving files run through the same pipeline. Each
  micro-batch is prepared row by row with ``foreachBatch`` and written under its epoch id
  (an overwrite of that epoch's folder: a retried epoch replaces its output). A batch may
  arrive over many epochs, so its limits are judged over all of them when the rows are read
  (``read_prepared``), and the result equals the batch pipeline's whatever the triggers.
* ST2 ``dedupe_stream``: first file to arrive per key within the watermark;
  ``first_stream``: the file with the least ``ord`` per key, whatever the order of arrival.
* ST3 ``progress_stream``: running done/ok/failed per batch, a stateful
  streaming aggregate (state in the checkpoint), written in update mode
  (``write_updates``): each epoch adds only the batches it changed; with the
  announced totals of the batches also the percent done.

All checkpoints and outputs live under the shared folder named by
``spark.checkpoint.dir`` (``docprep.session.checkpoint_dir``).
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.plans.prepare import apply_batch_limits, prepare
from docprep.session import checkpoint_dir, spread


def scratch(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """A parquet file stream (new files in ``path`` become new rows)."""
    reader = spark.readStream.format("parquet").schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def prepare_stream(
    stream: DataFrame,
    out_dir: str,
    checkpoint: str,
    to_files: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = True,
    **prepare_opts,
):
    """ST1: start the streaming pipeline; returns the StreamingQuery."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch = spread(batch)  # few or small files are few tasks
        files = to_files(batch) if to_files else batch
        out = prepare(files, batch_limits=False, **prepare_opts).withColumn("epoch", F.lit(epoch).cast("long"))
        out.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_prepared(spark: SparkSession, out_dir: str) -> DataFrame:
    """The rows of ``prepare_stream`` so far, with the batch limits over all epochs."""
    return apply_batch_limits(spark.read.parquet(out_dir))


def dedupe_stream(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """ST2: drop later copies of a key seen within the watermark delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def first_stream(stream: DataFrame, keys: list[str], event_time: str, ord_col: str = "ord", gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """ST2 by A3's rule: of a key's rows within ``gap`` of each other, that with the least ``ord_col`` (append mode).

    A session of the key holds the least row so far (one row of state, merged map-side) and is given out when the
    watermark passes its end, so rows that arrive in any order, up to ``delay`` late, give the same result. Ties of ``ord_col``: any of them; a null comes
    only where a key has no other. Rows with a null ``event_time`` belong to no session.
    """
    cols = [c for c in stream.columns if c not in keys]
    marked = stream.withWatermark(event_time, delay)
    # a null ord sorts after every number
    first = F.min_by(F.struct(*cols), F.struct(F.col(ord_col).isNull(), F.col(ord_col)))
    found = marked.groupBy(F.session_window(event_time, gap).alias("__session"), *keys).agg(first.alias("__first"))
    return found.select(*keys, "__first.*")


def progress_stream(results: DataFrame, batch_col: str = "batch_id", announced: DataFrame | None = None) -> DataFrame:
    """ST3: running totals per batch over a stream of pipeline rows.

    ``announced`` (``batch_col``, ``announced``; one row a batch, static) adds the announced total and the ``percent`` done of it,
    a whole number rounded half up; both are null for a batch that was not announced, percent also for a total of 0.
    """
    totals = {
        "total_files": F.count(F.lit(1)),
        "successful": F.count_if(F.col("status") == "success"),
        "failed": F.count_if(F.col("status") == "error"),
    }
    if announced is None:
        return results.groupBy(batch_col).agg(*[c.alias(n) for n, c in totals.items()])
    told = announced.select(batch_col, F.col("announced").cast("long").alias("announced"))
    rows = results.select(batch_col, "status").join(told, batch_col, "left")
    done = rows.groupBy(batch_col).agg(*[c.alias(n) for n, c in totals.items()], F.max("announced").alias("announced"))
    percent = F.floor((F.col("total_files") * 200 + F.col("announced")) / (F.nullif(F.col("announced"), F.lit(0)) * 2))
    return done.withColumn("percent", percent.cast("long"))


def write_updates(agg: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True):
    """Materialise a streaming aggregate in update mode: each epoch writes only
    the groups it changed, under ``epoch=<id>`` (overwritten when an epoch is
    retried). Output per trigger grows with the changes, not with every group
    ever seen; ``latest_rows`` gives the current table."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    writer = agg.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def latest_rows(df: DataFrame, key_cols: list[str], epoch_col: str = "epoch") -> DataFrame:
    """The last written row of each group (``max_by`` over the epoch, combined map-side)."""
    cols = [c for c in df.columns if c not in key_cols and c != epoch_col]
    picked = df.groupBy(*key_cols).agg(F.max_by(F.struct(*cols), F.col(epoch_col)).alias("__last"))
    return picked.select(*key_cols, "__last.*")


def write_append(stream: DataFrame, out_dir: str, checkpoint: str):
    return (
        stream.writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
