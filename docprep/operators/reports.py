"""Per-document and per-group reports: tokens per platform, savings, formats, PII.

Per-platform figures come from exploding a 4-element literal array (no join),
and every summary is a ``groupBy`` with partial aggregation, so hot groups are
combined map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.functions import tokens as T
from docprep.functions.text import utf16_length
from docprep.sources.catalogs import PLATFORMS


def _platforms_array():
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("platform_ordinal"),
                F.lit(key).alias("platform"),
                F.lit(label).alias("platform_label"),
                F.lit(float(cpt)).alias("chars_per_token"),
                F.lit(window).cast("long").alias("context_window"),
            )
            for i, (key, label, cpt, window) in enumerate(PLATFORMS)
        ]
    )


def per_platform(df: DataFrame, text_col: str = "text") -> DataFrame:
    """J3 + T1-T6: one row per document and platform with tokens and fit."""
    exploded = df.withColumn("__u16", utf16_length(F.col(text_col))).withColumn("__p", F.explode(_platforms_array()))
    exploded = exploded.select("*", F.col("__p.*")).drop("__p")
    tok = F.when(F.col("__u16") == 0, F.lit(0).cast("long")).otherwise(
        F.ceil(F.col("__u16").cast("double") / F.col("chars_per_token"))
    )
    out = exploded.withColumn("tokens", tok)
    window = F.col("context_window")
    return out.withColumns(
        {
            "fits": T.fits(F.col("tokens"), window),
            "fill_pct": F.round(T.fill_pct(F.col("tokens"), window), 6),
            "pct_label": T.pct_label(F.col("tokens"), window),
            "tokens_short": T.abbreviate_tokens(F.col("tokens")),
            "tokens_es": T.format_count_es(F.col("tokens")),
            "window_short": T.abbreviate_window(window),
        }
    ).drop("__u16")


def token_summary(df: DataFrame, text_col: str = "text", group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Per platform (and group): documents, total tokens, documents that fit / exceed."""
    rows = per_platform(df.select(*group_cols, text_col), text_col)
    return rows.groupBy(*group_cols, "platform_ordinal", "platform", "context_window").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("tokens").alias("total_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.count_if(F.col("fits")).alias("docs_fit"),
        F.count_if(~F.col("fits")).alias("docs_over"),
    )


def savings(df: DataFrame, original_col: str = "original_chars", text_col: str = "markdown_content") -> DataFrame:
    """J5 + T8 + T10: per-document compression statistics (same row, no join)."""
    stats = T.compression_stats(F.col(original_col), F.col(text_col))
    return df.withColumn("__s", stats).withColumns(
        {
            "final_chars": utf16_length(F.col(text_col)),
            "saved_chars": F.col("__s.saved_chars"),
            "saved_pct": F.col("__s.pct"),
            "saved_tokens": F.col("__s.saved_tokens"),
            "compression_label": T.compression_label(F.lit(True), F.col(original_col), F.col(text_col)),
        }
    ).drop("__s")


def savings_summary(df: DataFrame, group_cols: tuple[str, ...], original_col: str = "original_chars", text_col: str = "markdown_content") -> DataFrame:
    """A5: totals per group: original, final, saved characters and saved percentage."""
    staged = df.select(*group_cols, F.col(original_col).alias("__o"), utf16_length(F.col(text_col)).alias("__f"))
    agg = staged.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("__o").alias("original_chars"),
        F.sum("__f").alias("final_chars"),
    )
    return agg.withColumns(
        {
            "saved_chars": F.col("original_chars") - F.col("final_chars"),
            "saved_pct": F.round((F.col("original_chars") - F.col("final_chars")) * 100.0 / F.col("original_chars"), 4),
        }
    )


def format_mix(df: DataFrame, size_col: str = "length") -> DataFrame:
    """Documents and bytes per format label (expects ``format``)."""
    return df.groupBy("format").agg(F.count(F.lit(1)).alias("n_files"), F.sum(size_col).alias("total_bytes"))
