"""Whitespace classes and small string helpers shared by every kernel.

Regexes here are written in the common subset of Java regex (Spark) and RE2
(the DuckDB oracle): no look-around, no back-references, explicit character
classes instead of ``\\s``/``\\d`` (which are ASCII in Java but Unicode in the
semantics we reproduce).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's ``str.isspace()`` is true,
# i.e. what ``strip()``/``rstrip()``/``\s`` remove or match in the semantics we
# reproduce: \t \n \x0b \x0c \r, \x1c-\x1f, space, \x85 and the Unicode
# separators (category Z: U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000).
WS_CHARS = r"\t\n\x0b\x0c\r\x1c-\x1f \x85\p{Z}"
WS_CHARS_NO_NL = r"\t\x0b\x0c\r\x1c-\x1f \x85\p{Z}"
WS = f"[{WS_CHARS}]"
WS_NO_NL = f"[{WS_CHARS_NO_NL}]"
NON_WS = f"[^{WS_CHARS}]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a Column -> Column lambda).

    Catalyst may inline a sub-expression at every place it is used; binding it
    as the variable of a one-element ``transform`` evaluates it exactly once.
    """
    return F.transform(F.array(value), body)[0]


def strip_ws(col: Column) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(col, f"^{WS}++|(?<!{WS}){WS}++\\z", "")


def rstrip_ws(col: Column) -> Column:
    """``str.rstrip()`` on a single line."""
    return F.regexp_replace(col, f"(?<!{WS}){WS}++\\z", "")


def not_blank(col: Column) -> Column:
    """True when the text has a non-whitespace character (P6); NULL -> False."""
    return F.coalesce(col.rlike(NON_WS), F.lit(False))


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 code units (what a browser's ``String.length`` reports)."""
    return F.coalesce(F.octet_length(F.encode(col, "UTF-16BE")) / 2, F.lit(0)).cast("long")


def sql_str(value: str) -> str:
    """Render a Python string as a DuckDB string expression.

    Printable ASCII goes into a quoted literal; every other character becomes
    ``chr(n)`` so the SQL text stays plain ASCII and needs no escape syntax.
    """
    parts: list[str] = []
    buf: list[str] = []

    def flush() -> None:
        if buf:
            parts.append("'" + "".join(buf).replace("'", "''") + "'")
            buf.clear()

    for ch in value:
        if 0x20 <= ord(ch) < 0x7F:
            buf.append(ch)
        else:
            flush()
            parts.append(f"chr({ord(ch)})")
    flush()
    if not parts:
        return "''"
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def exclusive_prefix_sums(values: Column, block: int = 128) -> Column:
    """Exclusive running sums of a bigint array: [3, 1, 2] -> [0, 3, 4].

    Spark has no scan over arrays and a fold that appends is quadratic, so the
    array is cut into blocks: block totals are folded (n/block steps), then
    each block is folded from its offset (block steps each). Cost is about
    n * block + (n / block)^2 element copies instead of n^2 / 2.
    """

    def with_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
        init = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("out"))
        offsets = F.aggregate(
            totals, init, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
        )["out"]

        def within(offs: Column) -> Column:
            return F.flatten(
                F.transform(
                    blocks,
                    lambda b, i: F.aggregate(
                        b,
                        F.struct(offs[i].alias("s"), F.array().cast("array<bigint>").alias("out")),
                        lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")),
                    )["out"],
                )
            )

        return let(offsets, within)

    def run(v: Column) -> Column:
        n = F.size(v)
        nb = F.floor((n + block - 1) / block).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(nb - 1, F.lit(0))), lambda b: F.slice(v, b * block + 1, block))
        return F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(let(blocks, with_blocks))

    return let(values.cast("array<bigint>"), run)


# Code points per chunk when a text is cut at many code-point offsets.
CUT_CHUNK = 1024


def text_chunks(text: Column, chunk: int = CUT_CHUNK) -> Column:
    """The text as consecutive pieces of ``chunk`` code points (one regex pass)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), 0)


def cut(chunks: Column, a: Column, b: Column, chunk: int = CUT_CHUNK) -> Column:
    """Code points [a, b) (0-based) of the text cut into ``text_chunks``.

    A cut at a code-point offset walks a string from its start; taking it from
    at most two chunks plus the whole chunks between them keeps many cuts of
    one long text linear.
    """
    ca = F.floor(a / chunk).cast("int")
    cb = F.floor(b / chunk).cast("int")
    first = F.coalesce(F.try_element_at(chunks, ca + 1), F.lit(""))
    last = F.coalesce(F.try_element_at(chunks, cb + 1), F.lit(""))
    middle = F.array_join(F.slice(chunks, ca + 2, F.greatest(cb - ca - 1, F.lit(0))), "")
    return (
        F.when(b <= a, F.lit(""))
        .when(ca == cb, first.substr(a % chunk + 1, b - a))
        .otherwise(F.concat(first.substr(a % chunk + 1, F.lit(chunk)), middle, last.substr(F.lit(1), b % chunk)))
    )
