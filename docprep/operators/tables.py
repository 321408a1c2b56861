"""Rows -> Markdown pipe table.

``table_to_markdown`` makes one text a group: the groups are the tables of single files (bounded by
the 50 MB file limit), gathered with ``collect_list``. ``table_parts`` takes tables of any height:
blocks of rows in order, each a bounded text of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprep.operators.admission import with_places

PART_ROWS = 10_000

def _cell(c: Column) -> Column:
    v = F.coalesce(c.cast("string"), F.lit(""))
    v = F.replace(v, F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(v, "\r\n?|\n", " ")


def row_line(cols: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(F.col(c)) for c in cols]), F.lit(" |"))


def header_lines(cols: list[str]) -> str:
    head = "| " + " | ".join(c.replace("|", "\\|") for c in cols) + " |"
    sep = "| " + " | ".join("---" for _ in cols) + " |"
    return head + "\n" + sep


def table_to_markdown(df: DataFrame, group_cols: list[str], order_cols: list[str], cols: list[str]) -> DataFrame:
    """One row per group with ``markdown`` = header, ``---`` row, body rows in order."""
    staged = df.select(*group_cols, F.struct(*[F.col(c) for c in order_cols], row_line(cols).alias("line")).alias("r"))
    agg = staged.groupBy(*group_cols).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    body = F.array_join(F.transform(F.col("rows"), lambda r: r["line"]), "\n")
    return agg.select(*group_cols, F.concat(F.lit(header_lines(cols) + "\n"), body).alias("markdown"))


def table_parts(df: DataFrame, group_cols: list[str], order_cols: list[str], cols: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """X5 for tables of any height: ``(group columns, part, n_rows, markdown)``, ``part_rows`` rows a part.

    Parts are numbered from 0 in the order of the rows; part 0 begins with the header. A table's parts joined by line feeds
    are the text ``table_to_markdown`` makes. No task holds more than its parts: places come from prefix sums over
    range partitions, so a table with a third of all rows is many tasks. Rows equal in ``order_cols`` are ordered by their lines; a table without rows has no part.
    """
    lines = df.select(*group_cols, *[F.col(c).alias(f"__order{i}") for i, c in enumerate(order_cols)], row_line(cols).alias("__line"))
    # the last key spreads rows that are equal in everything else, whose order does not show
    lines = lines.withColumn("__tie", F.monotonically_increasing_id())
    order = [*(f"__order{i}" for i in range(len(order_cols))), "__line", "__tie"]
    placed = with_places(lines, group_cols, order, "__place")
    part = F.floor(F.col("__place") / part_rows).cast("long")
    gathered = placed.groupBy(*group_cols, part.alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list(F.struct("__place", "__line"))).alias("__rows")
    )
    body = F.array_join(F.transform("__rows", lambda r: r["__line"]), "\n")
    head = F.when(F.col("part") == 0, F.lit(header_lines(cols) + "\n")).otherwise(F.lit(""))
    return gathered.select(*group_cols, "part", "n_rows", F.concat(head, body).alias("markdown"))
