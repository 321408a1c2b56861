"""Token estimates, context-window fit, compression statistics.

Lengths here are UTF-16 code units, as a browser measures them; the
``original_chars`` recorded by the pipeline is in code points. Mixing the two
is deliberate: it is how the statistics are defined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docprep.functions.text import utf16_length

# Browser whitespace (what JavaScript's \s matches).
JS_WS = "[\\t\\n\\x0b\\x0c\\r\\p{Z}\\x{feff}]"
JS_NON_WS = "[^\\t\\n\\x0b\\x0c\\r\\p{Z}\\x{feff}]"
# Characters per token used for the saved-token estimate.
SAVED_CHARS_PER_TOKEN = 4.0
MINUS = "\u2212"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def estimate_tokens(text: Column | str, chars_per_token: Column | float) -> Column:
    """ceil(utf16 length / chars per token); NULL or '' -> 0."""
    cpt = F.lit(float(chars_per_token)) if isinstance(chars_per_token, (int, float)) else chars_per_token
    n = utf16_length(_col(text))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.ceil(n.cast("double") / cpt.cast("double")))


def fits(tokens: Column, window: Column) -> Column:
    """A document fits when tokens <= window (equality fits)."""
    return tokens <= window


def window_ratio(tokens: Column, window: Column) -> Column:
    """Tokens / window, 0 when there is no window."""
    return F.when(window == 0, F.lit(0.0)).otherwise(tokens.cast("double") / window.cast("double"))


def fill_pct(tokens: Column, window: Column) -> Column:
    """Visible fill, at least 2 % when there are tokens, at most 100 %."""
    floor_pct = F.when(tokens > 0, F.lit(2.0)).otherwise(F.lit(0.0))
    return F.least(F.lit(100.0), F.greatest(floor_pct, window_ratio(tokens, window) * 100))


def format_count_es(n: Column) -> Column:
    """Es-ES grouping; numbers below 10,000 get no separator (1250, 12.345)."""
    return F.when(F.abs(n) < 10000, n.cast("string")).otherwise(F.translate(F.format_number(n, 0), ",", "."))


def _one_decimal_es(x: Column) -> Column:
    """Round half-up to one decimal, Spanish comma, trailing ',0' dropped."""
    tenths = F.floor(x * 10 + 0.5).cast("long")
    whole = F.floor(tenths / 10).cast("long")
    frac = tenths - whole * 10
    return F.when(frac == 0, format_count_es(whole)).otherwise(F.concat(format_count_es(whole), F.lit(","), frac.cast("string")))


def pct_label(tokens: Column, window: Column) -> Column:
    """T4: share of the window, shown only from 0.1 %: '12,5% de ', else ''."""
    ratio = window_ratio(tokens, window)
    return F.when(ratio >= 0.001, F.concat(_one_decimal_es(ratio * 100), F.lit("% de "))).otherwise(F.lit(""))


def abbreviate_tokens(n: Column) -> Column:
    """T5: 999 -> '999', 12345 -> '12,3k', 1200000 -> '1,2M'.

    Rounding is half-up on the decimal value. The browser rounds the binary
    double instead, so exact ties whose double lies below the tie (1450 ->
    '1,4k' there) come out one tenth higher here ('1,5k').
    """
    k = F.floor((n + 50) / 100).cast("long")  # tenths of a thousand
    m = F.floor((n + 50000) / 100000).cast("long")  # tenths of a million

    def fmt(tenths: Column, unit: str) -> Column:
        return F.concat((tenths / 10).cast("long").cast("string"), F.lit(","), (tenths % 10).cast("string"), F.lit(unit))

    return F.when(n < 1000, n.cast("string")).when(n < 1000000, fmt(k, "k")).otherwise(fmt(m, "M"))


def abbreviate_window(n: Column) -> Column:
    """128000 -> '128k', 1000000 -> '1M', 1500000 -> '1,5M'."""
    return (
        F.when(n >= 1000000, F.concat(_one_decimal_es(n / 1000000.0), F.lit("M")))
        .when(n >= 1000, F.concat(F.floor(n / 1000.0 + 0.5).cast("long").cast("string"), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def compression_stats(original_chars: Column, text: Column) -> Column:
    """struct(original_chars, final_chars, saved_chars, pct, saved_tokens) or NULL.

    NULL when there is no original length, nothing was saved, or the rounded
    percentage is 0.
    """
    final = utf16_length(text)
    saved = original_chars - final
    pct = F.floor((saved.cast("double") / original_chars.cast("double")) * 100 + 0.5).cast("long")
    saved_tokens = F.floor(saved.cast("double") / SAVED_CHARS_PER_TOKEN + 0.5).cast("long")
    valid = original_chars.isNotNull() & (original_chars != 0) & (original_chars > final)
    return F.when(
        valid & (pct > 0),
        F.struct(
            original_chars.cast("long").alias("original_chars"),
            final.alias("final_chars"),
            saved.cast("long").alias("saved_chars"),
            pct.alias("pct"),
            saved_tokens.alias("saved_tokens"),
        ),
    )


def compression_label(compacted: Column, original_chars: Column, text: Column) -> Column:
    """NULL when not compacted, 'sin reducción' when nothing was saved, else '−18%'."""
    stats = compression_stats(original_chars, text)
    return (
        F.when(~F.coalesce(compacted, F.lit(False)), F.lit(None).cast("string"))
        .when(stats.isNull(), F.lit("sin reducción"))
        .otherwise(F.concat(F.lit(MINUS), stats["pct"].cast("string"), F.lit("%")))
    )


def text_stats(text: Column) -> Column:
    """struct(chars, words, lines) as the preview reports them."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(
        utf16_length(t).alias("chars"),
        F.size(F.regexp_extract_all(t, F.lit(JS_NON_WS + "+"), 0)).cast("long").alias("words"),
        F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "\n", -1))).cast("long").alias("lines"),
    )
