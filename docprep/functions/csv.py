"""CSV text -> Markdown pipe table (X5, X6) as one native Column expression.

The text is cut at every double quote, so the parts alternate outside / inside quotes and the parity of a part tells
which commas and line ends separate. Those outside become two control characters, an empty part between two
quoted ones is a doubled quote, and the parts are joined again: cutting at the control characters then
gives records and cells, wherever quoted commas, quotes and line ends stand. Linear in the text; an open quote protects the rest.

The first record is the header; every row has as many cells as the longest record (missing ones empty). In a cell
``|`` is escaped and line ends become blanks. Records without any character are left out; a text without records is ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docprep.functions.text import let

# Separators of cells and records while the text is cut; the same characters in the text become blanks.
CELL, RECORD = "\x1f", "\x1e"


def separated(text: Column) -> Column:
    """The text with ``CELL`` and ``RECORD`` for the separators outside quotes, and without its quotes."""

    def part(p: Column, i: Column, n: Column) -> Column:
        outside = F.translate(F.regexp_replace(p, "\r\n?", "\n"), ",\n", CELL + RECORD)
        doubled = (p == "") & (i > 0) & (i < n - 1)
        return F.when(i % 2 == 1, p).when(doubled, F.lit('"')).otherwise(outside)

    clean = F.translate(text, CELL + RECORD, "  ")
    return let(F.split(clean, '"', -1), lambda ps: F.array_join(F.transform(ps, lambda p, i: part(p, i, F.size(ps))), ""))


def _cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), "\r\n?|\n", " ")


def csv_to_markdown(col: Column) -> Column:
    """Pipe table of a CSV text (NULL stays NULL)."""

    def table(rows: Column) -> Column:
        # cells of a row: one more than its separators
        width = F.array_max(F.transform(rows, lambda r: F.size(F.split(r, CELL, -1))))

        def line(r: Column) -> Column:
            cells = F.split(r, CELL, -1)
            filled = F.concat(F.transform(cells, _cell), F.array_repeat(F.lit(""), width - F.size(cells)))
            return F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))

        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        lines = F.transform(rows, lambda r, i: F.when(i == 0, F.concat(line(r), F.lit("\n"), rule)).otherwise(line(r)))
        return F.when(F.size(rows) == 0, F.lit("")).otherwise(F.array_join(lines, "\n"))

    rows = F.filter(F.split(separated(col), RECORD, -1), lambda r: r != "")
    return F.when(col.isNotNull(), let(rows, table))
