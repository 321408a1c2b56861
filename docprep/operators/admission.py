"""Admission of files into batches: formats, sizes, batch limits, error codes.

Input rows are files: ``batch_id, ord, filename, length`` (+ text or content).
Batch-level limits are computed with a ``groupBy`` over the narrow (batch, size)
columns (partial aggregation, so a batch holding a third of all rows is still
combined map-side); only the rejected batches are joined back, broadcast after
a size check. No window runs over a whole batch. The 25-row format catalogue
is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docprep.functions.names import extension, extension_lenient, markdown_filename, safe_filename
from docprep.session import checkpoint_dir
from docprep.sources import catalogs as C

# Error codes and their HTTP-style status.
ERROR_STATUS: dict[str, int] = {
    "UNSUPPORTED_FORMAT": 400,
    "TOO_MANY_FILES": 400,
    "EMPTY_BATCH": 400,
    "FILE_TOO_LARGE": 413,
    "BATCH_TOO_LARGE": 413,
    "EXTRACTOR_UNAVAILABLE": 503,
    "ANONYMIZER_UNAVAILABLE": 503,
    "FAILED": 500,
}


def _catalog(df: DataFrame) -> DataFrame:
    return F.broadcast(C.format_catalog(df.sparkSession).select("ext", "format", "is_image"))


def with_names(df: DataFrame, name_col: str = "filename") -> DataFrame:
    """N1/N2/N4 columns: safe name, lower-cased extension, suggested Markdown name."""
    return df.withColumns(
        {
            "safe_name": safe_filename(F.col(name_col)),
            "ext": extension(F.col(name_col)),
            "markdown_filename": markdown_filename(F.col(name_col)),
        }
    )


def with_format(df: DataFrame, ext_col: str = "ext") -> DataFrame:
    """Format label from the broadcast catalogue; a miss becomes 'Unknown'."""
    cat = _catalog(df).withColumnRenamed("ext", "__ext")
    out = df.join(cat, F.col(ext_col) == F.col("__ext"), "left").drop("__ext")
    return out.withColumns({"format": F.coalesce("format", F.lit("Unknown")), "is_image": F.coalesce("is_image", F.lit(False))})


def supported(df: DataFrame, ext_col: str = "ext") -> DataFrame:
    """Rows whose extension is in the catalogue (broadcast left-semi)."""
    cat = _catalog(df).select(F.col("ext").alias("__ext"))
    return df.join(cat, F.col(ext_col) == F.col("__ext"), "left_semi")


def unsupported(df: DataFrame, ext_col: str = "ext") -> DataFrame:
    """Rows whose extension is not in the catalogue (broadcast left-anti)."""
    cat = _catalog(df).select(F.col("ext").alias("__ext"))
    return df.join(cat, F.col(ext_col) == F.col("__ext"), "left_anti")


def client_supported(df: DataFrame, name_col: str = "filename") -> DataFrame:
    """The browser-side filter: lenient extension (from the last dot) in the catalogue."""
    return supported(df.withColumn("__lext", extension_lenient(F.col(name_col))), "__lext").drop("__lext")


def with_support(df: DataFrame, ext_col: str = "ext", name_col: str = "filename") -> DataFrame:
    """Both checks as flags of every row, ``supported`` and ``client_supported``: one scan, two broadcast joins."""
    cat = _catalog(df).select("ext")
    strict = cat.select(F.col("ext").alias("__cat"), F.lit(True).alias("__in"))
    lenient = cat.select(F.col("ext").alias("__lcat"), F.lit(True).alias("__lin"))
    out = df.join(strict, F.col(ext_col) == F.col("__cat"), "left").join(lenient, extension_lenient(F.col(name_col)) == F.col("__lcat"), "left")
    flags = {"supported": F.coalesce("__in", F.lit(False)), "client_supported": F.coalesce("__lin", F.lit(False))}
    return out.withColumns(flags).drop("__cat", "__in", "__lcat", "__lin")


def batch_stats(df: DataFrame, batch_col: str = "batch_id", size_col: str = "length") -> DataFrame:
    """Per batch: file count and total known bytes (partial aggregation)."""
    return df.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("batch_files"),
        F.sum(size_col).alias("batch_bytes"),
    )


# Largest set of rejected batches that is broadcast to the files; beyond it
# the (still narrow) rejected set is joined with a shuffle.
MAX_BROADCAST_BATCHES = 500_000


def rejected_batches(
    df: DataFrame,
    batch_col: str = "batch_id",
    size_col: str = "length",
    max_files: int = C.MAX_FILES_PER_BATCH,
    max_batch_bytes: int = C.MAX_BATCH_BYTES,
) -> DataFrame:
    """``(batch, batch_code)`` for every batch over a limit (too many
    files first, then too many known bytes; unknown sizes pass)."""
    code = F.when(F.col("batch_files") > max_files, F.lit("TOO_MANY_FILES")).when(
        F.coalesce(F.col("batch_bytes") > max_batch_bytes, F.lit(False)), F.lit("BATCH_TOO_LARGE")
    )
    stats = batch_stats(df.select(batch_col, size_col), batch_col, size_col)
    return stats.select(batch_col, code.alias("__batch_code")).filter(F.col("__batch_code").isNotNull())


def checked_rejected(
    df: DataFrame,
    batch_col: str = "batch_id",
    size_col: str = "length",
    max_files: int = C.MAX_FILES_PER_BATCH,
    max_batch_bytes: int = C.MAX_BATCH_BYTES,
    max_broadcast_batches: int = MAX_BROADCAST_BATCHES,
) -> DataFrame:
    """The rejected batches of ``df``, marked for broadcast when their count is
    within ``max_broadcast_batches`` (the size check behind the broadcast)."""
    over = rejected_batches(df, batch_col, size_col, max_files, max_batch_bytes)
    if over.count() <= max_broadcast_batches:
        over = F.broadcast(over)
    return over


def admit(
    df: DataFrame,
    batch_col: str = "batch_id",
    size_col: str = "length",
    max_files: int = C.MAX_FILES_PER_BATCH,
    max_file_size: int = C.MAX_FILE_SIZE,
    max_batch_bytes: int = C.MAX_BATCH_BYTES,
    max_broadcast_batches: int = MAX_BROADCAST_BATCHES,
    rejected: DataFrame | None = None,
) -> DataFrame:
    """Add ``error_code``/``error``/``http_status`` for the first failed check.

    Order: too many files in the batch, batch too large, unsupported format,
    file too large. A batch over a limit is rejected whole, never truncated.
    Expects ``ext``/``format`` (``with_names`` + ``with_format``).

    Only the batches over a limit are joined back to the files. Their number is
    counted first (a job over the narrow ``(batch, size)`` columns); when it is
    within ``max_broadcast_batches`` they are broadcast, so the files (and
    their text) are never shuffled. Otherwise the join shuffles; AQE splits a
    hot batch on the file side. ``rejected`` (from ``checked_rejected``) lets
    several parts of one file table share the batch decision.
    """
    if rejected is None:
        rejected = checked_rejected(df, batch_col, size_col, max_files, max_batch_bytes, max_broadcast_batches)
    joined = df.join(rejected, batch_col, "left")
    code = (
        F.when(F.col("__batch_code").isNotNull(), F.col("__batch_code"))
        .when(F.col("format") == "Unknown", F.lit("UNSUPPORTED_FORMAT"))
        .when(F.coalesce(F.col(size_col) > max_file_size, F.lit(False)), F.lit("FILE_TOO_LARGE"))
    )
    return joined.withColumn("error_code", code).withColumns(
        {"error": error_message(F.col("error_code")), "http_status": http_status(F.col("error_code"))}
    ).drop("__batch_code")


def error_message(code: Column) -> Column:
    return (
        F.when(code == "UNSUPPORTED_FORMAT", F.lit(C.UNSUPPORTED_MESSAGE))
        .when(code == "FILE_TOO_LARGE", F.lit(C.TOO_LARGE_MESSAGE))
        .when(code == "TOO_MANY_FILES", F.lit(C.TOO_MANY_MESSAGE))
        .when(code == "BATCH_TOO_LARGE", F.lit(C.BATCH_TOO_LARGE_MESSAGE))
        .when(code == "EMPTY_BATCH", F.lit(C.EMPTY_MESSAGE))
        .when(code == "EXTRACTOR_UNAVAILABLE", F.lit(C.EXTRACTOR_MESSAGE))
    )


def http_status(code: Column) -> Column:
    expr = None
    for name, status in ERROR_STATUS.items():
        expr = F.when(code == name, F.lit(status)) if expr is None else expr.when(code == name, F.lit(status))
    return expr


def empty_batches(batches: DataFrame, files: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """P5: one EMPTY_BATCH error row per batch id that has no file.

    Both sides are reduced to distinct ids first (map-side partial
    aggregation), so a batch with many files is one row in the anti join."""
    missing = batches.select(batch_col).distinct().join(files.select(batch_col).distinct(), batch_col, "left_anti")
    return missing.withColumns(
        {"error_code": F.lit("EMPTY_BATCH"), "error": F.lit(C.EMPTY_MESSAGE), "http_status": F.lit(400)}
    )


def dedupe_files(df: DataFrame, keys=("batch_id", "filename", "length"), ord_col: str = "ord") -> DataFrame:
    """A3: first file (lowest ``ord``) per (batch, name, size); contents are not compared.

    ``min_by`` over a struct is combined map-side, so a key holding a third of
    all rows never lands whole in one task.
    """
    cols = [c for c in df.columns]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(ord_col)).alias("__first"))
    return picked.select("__first.*")


def order_results(df: DataFrame, batch_col: str = "batch_id", ord_col: str = "ord") -> DataFrame:
    """Position in the batch listing: results first, then errors, each in input order.

    Rejected batches (a batch-level error) have no listing: position NULL. One
    window in one pass: an admitted batch (at most 50 rows) is one window
    partition, while each row of a rejected batch is keyed alone by its
    ``ord``, so a rejected batch of any size is spread over many tasks.
    """
    batch_level = F.coalesce(F.col("error_code").isin("TOO_MANY_FILES", "BATCH_TOO_LARGE"), F.lit(False))
    rank = F.when(F.col("status") == "success", F.lit(0)).otherwise(F.lit(1))
    w = Window.partitionBy(F.col(batch_col), F.when(batch_level, F.col(ord_col))).orderBy(rank, F.col(ord_col))
    return df.withColumn("position", F.when(~batch_level, F.row_number().over(w) - 1).cast("int"))


def assign_batches(df: DataFrame, size: int = C.MAX_FILES_PER_BATCH, bucket: str | None = None) -> DataFrame:
    """Split a corpus into batches of at most ``size`` rows (P3 then holds).

    No shuffle. Without a bucket the batch id comes from the row's position
    inside its input partition (a projection). With a bucket each input
    partition is sorted locally by (bucket, input order), rows are numbered in
    that order and cut into blocks of ``size`` positions; a batch is the rows
    of one bucket in one block of one partition. So a batch never mixes
    buckets, a bucket's run gets at most two partial batches per partition, and
    a hot bucket stays spread over all its input partitions. Ids are stable
    for a stable input layout. With a bucket the id is the text ``partition:block:bucket``: exact, no hash.
    """
    mono = F.monotonically_increasing_id()
    if bucket is None:
        local = F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
        return (
            df.withColumn("__mono", mono)
            .withColumn("batch_id", F.col("__mono") - local + F.floor(local / size).cast("long"))
            .withColumn("ord", (local % size).cast("int"))
            .drop("__mono")
        )
    staged = df.withColumn("__in", mono).sortWithinPartitions(bucket, "__in").withColumn("__pos", mono)
    local = F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        staged.withColumn(
            "batch_id",
            F.concat_ws(":", F.spark_partition_id(), F.floor(local / size).cast("long"), F.col(bucket).cast("string")),
        )
        .withColumn("ord", (local % size).cast("int"))
        .drop("__in", "__pos")
    )


def assign_ordered_batches(df: DataFrame, bucket: str, order: list[str], size: int = C.MAX_FILES_PER_BATCH) -> DataFrame:
    """W4 whatever the layout of the input: ``batch_id`` (``bucket:number``) and ``ord`` by the row's place in its bucket.

    Rows are sorted by ranges of (bucket, order), so a bucket of any size lies over many partitions. A row's place is its place in
    the partition plus the rows of its bucket in the partitions before: a prefix sum over one total a bucket and
    partition. No window sees the rows of a bucket. ``order`` must tell the rows of a bucket apart; nulls come first,
    and rows with a null bucket are a bucket of their own, whose ids begin with ``:``. Existing columns named like the two new ones are replaced.
    """
    key = F.coalesce(F.col(bucket).cast("string"), F.lit(""))
    placed = with_places(df.drop("batch_id", "ord"), [bucket], order, "__place")
    place = F.col("__place")
    out = placed.withColumn("batch_id", F.concat_ws(":", key, F.floor(place / size).cast("string"))).withColumn("ord", (place % size).cast("int"))
    return out.drop("__place")


def with_places(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the row's place (from 0) in its group by ``order``, nulls first, without a window over a group's rows.

    Rows are sorted by ranges of (groups, order): a group of any size lies over many partitions, and a place is the one in
    the partition plus the group's rows in the partitions before (prefix sums over one total a group and partition). Null is a value of a group.
    """
    n = df.sparkSession.sparkContext.defaultParallelism * 2
    checkpoint_dir(df.sparkSession)
    by = [F.col(c).asc_nulls_first() for c in (*groups, *order)]
    placed = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = placed.checkpoint()  # partitions and places are fixed from here on, also for tasks that run again
    part = F.shiftright("__at", 33)
    keys = [F.col(g).alias(f"__group{i}") for i, g in enumerate(groups)]
    totals = placed.groupBy(*keys, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    named = [f"__group{i}" for i in range(len(groups))]
    before = Window.partitionBy(*named).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    same = part == F.col("__part")
    for g, k in zip(groups, named):
        same = same & F.col(g).eqNullSafe(F.col(k))
    # no hint: one row a group and partition, broadcast by Spark where its measured size allows
    joined = placed.join(totals, same).withColumn(name, F.col("__before") + F.col("__at") - F.col("__first"))
    return joined.drop("__at", *named, "__part", "__n", "__first", "__before")


def union_outcomes(results: DataFrame, errors: DataFrame) -> DataFrame:
    """Results and errors in one table, tagged by ``status``."""
    return results.withColumn("status", F.lit("success")).unionByName(
        errors.withColumn("status", F.lit("error")), allowMissingColumns=True
    )


def batch_summary(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """A1: total_files, successful, failed per batch."""
    return df.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
    )


def error_summary(df: DataFrame) -> DataFrame:
    """A2: error rows per code."""
    return (
        df.filter(F.col("status") == "error")
        .groupBy("error_code")
        .agg(F.count(F.lit(1)).alias("n_errors"), F.min("http_status").alias("http_status"))
    )
