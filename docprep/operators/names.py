"""Unique names inside a batch.

In input order, the first taker keeps a name; later ones get `` (2)``,
`` (3)``... before the last extension, skipping any name already taken
(including a literal ``doc (2).md`` seen earlier). The fold runs over the
names of one batch in input order, which admission bounds to 50 files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprep.functions.text import let


def _candidate(name: Column, i: Column) -> Column:
    """``stem (i).ext`` using rpartition('.'): no dot -> ``name (i)``; empty ext -> no dot."""
    has_dot = F.instr(name, ".") > 0
    stem = F.regexp_replace(name, "(?s)\\.[^.]*\\z", "")
    ext = F.regexp_extract(name, "(?s)\\.([^.]*)\\z", 1)
    suffix = F.concat(F.lit(" ("), i.cast("string"), F.lit(")"))
    return (
        F.when(~has_dot, F.concat(name, suffix))
        .when(ext == "", F.concat(stem, suffix))
        .otherwise(F.concat(stem, suffix, F.lit("."), ext))
    )


def unique_in_order(names: Column) -> Column:
    """Fold an ordered array of names into unique names (same length, same order)."""

    def step(taken: Column, name: Column) -> Column:
        fresh = ~F.array_contains(taken, name)
        tries = F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda i: _candidate(name, i))
        first_free = F.filter(tries, lambda c: ~F.array_contains(taken, c))[0]
        return F.concat(taken, F.array(F.when(fresh, name).otherwise(first_free)))

    return F.aggregate(names, F.array().cast("array<string>"), step)


def unique_names(df: DataFrame, batch_col: str = "batch_id", ord_col: str = "ord", name_col: str = "name", out_col: str = "unique_name") -> DataFrame:
    """N6 as a table operator: adds ``out_col`` to every row of ``df``.

    One window over the batch in input order: each row folds the names up to
    itself and keeps the last one. The rows are exchanged once, by batch, so a
    following per-batch step (bundles) reuses that partitioning. Batches must
    be admitted ones (at most 50 rows): the fold is sequential by nature.
    """
    w = Window.partitionBy(batch_col).orderBy(ord_col, name_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefix = F.collect_list(F.struct(F.col(name_col).alias("n"))).over(w)
    return df.withColumn(out_col, F.element_at(unique_in_order(F.transform(prefix, lambda p: p["n"])), -1))
