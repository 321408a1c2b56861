"""File names, extensions and display formatting.

All are Column -> Column expressions; N6 (unique names inside a batch) needs
the batch, so it lives in ``docprep.operators.names``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docprep.sources.catalogs import MAX_FILENAME_LEN

CONTROL_RX = "[\\x00-\\x1f\\x7f]"
LAST_SEP_RX = "(?s)^.*[/\\\\]"
SUFFIX_RX = "(?s)^.+(\\.[^.]+)\\z"
TRAILING_SLASHES_RX = "(?:/\\.)*+/?\\z"  # after runs of slashes are one slash


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_filename(name: Column | str) -> Column:
    """Path components dropped (``/`` and ``\\``), control characters removed,
    cut to 255 code points; NULL or an empty result -> 'file'. ``< > " ' &`` stay."""
    n = _col(name)
    base = F.regexp_replace(n, LAST_SEP_RX, "")
    cut = F.substring(F.regexp_replace(base, CONTROL_RX, ""), 1, MAX_FILENAME_LEN)
    return F.when(n.isNull() | (cut == ""), F.lit("file")).otherwise(cut)


def _posix_name(name: Column) -> Column:
    """Last component of a POSIX path (trailing ``/`` and ``/.`` ignored)."""
    trimmed = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "/+", "/"), TRAILING_SLASHES_RX, "")
    return F.element_at(F.split(trimmed, "/", -1), -1)


def _suffix(base: Column) -> Column:
    return F.regexp_extract(base, SUFFIX_RX, 1)


def extension(name: Column | str) -> Column:
    """Lower-cased last suffix of the last ``/`` component ('a.tar.ZIP' -> '.zip',
    '.pdf' -> '', 'x.' -> ''). Backslashes are not separators here."""
    return F.lower(_suffix(_posix_name(_col(name))))


def extension_lenient(name: Column | str) -> Column:
    """From the last '.' anywhere, lower-cased ('.pdf' -> '.pdf', 'x.' -> '.')."""
    return F.lower(F.regexp_extract(F.coalesce(_col(name), F.lit("")), "(?s)(\\.[^.]*)\\z", 1))


def stem(name: Column | str) -> Column:
    """The last component without its suffix."""
    base = _posix_name(_col(name))
    suf = _suffix(base)
    return F.when(suf == "", base).otherwise(F.regexp_replace(base, "(?s)\\.[^.]+\\z", ""))


def markdown_filename(name: Column | str) -> Column:
    """Safe stem + '.md' ('hello.txt' -> 'hello.md', missing -> 'file.md')."""
    return F.concat(safe_filename(stem(name)), F.lit(".md"))


def ensure_md(name: Column | str) -> Column:
    """Append '.md' unless the name already ends so (case-insensitive)."""
    n = _col(name)
    return F.when(F.lower(n).endswith(".md"), n).otherwise(F.concat(n, F.lit(".md")))


def escape_html(value: Column | str) -> Column:
    """& < > " ' as entities (& first); NULL -> ''."""
    v = F.coalesce(_col(value).cast("string"), F.lit(""))
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        v = F.replace(v, F.lit(ch), F.lit(ent))
    return v


def _hundredths(h: Column) -> Column:
    """Integer hundredths -> shortest decimal text (150 -> '1.5', 200 -> '2')."""
    whole = (h / 100).cast("long").cast("string")
    frac = h % 100
    return (
        F.when(frac == 0, whole)
        .when(frac % 10 == 0, F.concat(whole, F.lit("."), (frac / 10).cast("long").cast("string")))
        .otherwise(F.concat(whole, F.lit("."), F.lpad(frac.cast("string"), 2, "0")))
    )


def format_size(nbytes: Column | str) -> Column:
    """N8: '0 Bytes', '512 Bytes', '1.5 KB', '2 MB' (units by powers of 1024).

    The unit is chosen with integer thresholds; the value is rounded to two
    decimals the same way the browser does (round(x * 100) / 100).
    """
    b = _col(nbytes).cast("long")
    unit_pow = F.when(b < 1024, 0).when(b < 1024**2, 1).when(b < 1024**3, 2).otherwise(3)
    scale = F.pow(F.lit(1024.0), unit_pow)
    h = F.floor((b.cast("double") / scale) * 100 + 0.5).cast("long")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB")]), unit_pow + 1)
    return F.when(b == 0, F.lit("0 Bytes")).otherwise(F.concat(_hundredths(h), F.lit(" "), unit))


def format_elapsed(ms: Column | str) -> Column:
    """N9: '850 ms' below a second, else seconds with one decimal ('1.3 s')."""
    m = _col(ms).cast("double")
    tenths = F.floor(m / 100 + 0.5).cast("long")
    secs = F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" s"))
    return F.when(m < 1000, F.concat(F.floor(m + 0.5).cast("long").cast("string"), F.lit(" ms"))).otherwise(secs)
