"""Lossless Markdown compaction (C1-C8) as one native Column expression.

Rules, in order:

1. ``\\r\\n`` and lone ``\\r`` become ``\\n``.
2. U+200B, U+FEFF and U+00AD are deleted; U+00A0 becomes a space.
3. HTML comments ``<!-- ... -->`` are deleted across lines (unclosed ones stay).
4. Lines are then classified. A line whose left-stripped text starts with three
   backticks or ``~~~`` toggles a fenced block (either marker closes either).
   Fence lines and lines inside a fence are kept verbatim.
5. Outside fences a line is right-stripped; an empty result is a *blank*; a line
   made only of pipes and spaces with two or more pipes is dropped.
6. Kept lines are joined with ``\\n``; between two kept lines one empty line is
   inserted when at least one blank lay between them. Leading and trailing
   blanks disappear. Identical lines are never merged.

Implementation (linear in the text length, no Python, no shuffle):

* the fence parity of every line comes from splitting the string of per-line
  fence flags on ``'1'``: the pieces alternate outside / inside;
* every line becomes a token ``E<content>`` (kept), ``B`` (blank) or NULL
  (dropped table row); the tokens are joined and four regex passes collapse the
  blank runs, trim the ends and remove the ``E`` prefixes;
* texts without any fence (the common case) skip the arrays altogether: five
  whole-string regex passes implement rules 5 and 6 directly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docprep.functions.text import WS, WS_NO_NL, let, rstrip_ws

# The characters deleted by rule 2, and the one turned into a space.
INVISIBLE_CHARS = "\u200b\ufeff\u00ad"  # zero-width space, BOM, soft hyphen
NBSP = "\u00a0"

FENCE_RX = f"^{WS}*(?:```|~~~)"
ANY_FENCE_RX = f"(?md)^{WS_NO_NL}*(?:```|~~~)"
# flat classes: a repeated group of varying length would recurse once per repeat
EMPTY_TABLE_ROW_RX = f"^{WS}*\\|{WS[:-1]}|]*\\|{WS}*\\z"
# an unclosed comment takes the rest of the text, which stays ($1): no later start is searched again
COMMENT_RX = "(?s)<!--.*?-->|(<!--.*+)"


def normalize_markdown(col: Column) -> Column:
    """Rules 1-3: newlines, invisible characters, HTML comments (whole text)."""
    t = F.regexp_replace(col, "\r\n?", "\n")
    # translate: the first matching char maps to ' ', the rest have no
    # counterpart and are deleted.
    t = F.translate(t, NBSP + INVISIBLE_CHARS, " ")
    return F.regexp_replace(t, COMMENT_RX, "$1")


def _line_kinds(lines: Column) -> Column:
    """Per line: 'F' fence line, 'I' inside a fence, 'O' outside."""
    flags = F.array_join(F.transform(lines, lambda l: F.when(l.rlike(FENCE_RX), "1").otherwise("0")), "")

    def expand(pieces: Column) -> Column:
        n = F.size(pieces)  # pieces is a bound variable here: O(1)
        return F.flatten(
            F.transform(
                pieces,
                lambda p, j: F.concat(
                    F.array_repeat(F.when(j % 2 == 1, F.lit("I")).otherwise(F.lit("O")), F.length(p)),
                    F.when(j < n - 1, F.array(F.lit("F"))).otherwise(F.array().cast("array<string>")),
                ),
            )
        )

    return let(F.split(flags, "1", -1), expand)


def _token(content: Column, kind: Column) -> Column:
    return (
        F.when(kind != "O", F.concat(F.lit("E"), content))
        .when(content == "", F.lit("B"))
        .when(content.rlike(EMPTY_TABLE_ROW_RX), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("E"), content))
    )


def _assemble(tokens: Column) -> Column:
    joined = F.array_join(F.filter(tokens, lambda x: x.isNotNull()), "\n")
    t = F.regexp_replace(joined, "^(?:B\n)*+(?:B\\z)?", "")  # leading blanks
    # trailing blanks; the look-behind starts a run at its first blank only, so a run inside the text is read once
    t = F.regexp_replace(t, "(?<!\nB)(?:\nB)++\\z", "")
    t = F.regexp_replace(t, "(?:\nB)+\n", "\n\n")  # a run of blanks -> one empty line
    return F.regexp_replace(t, "(^|\n)E", "$1")


def _compact_fenced(text: Column) -> Column:
    """Line arrays: kinds from the fence parity, right-strip only outside fences."""

    def with_lines(lines: Column) -> Column:
        def with_kinds(kinds: Column) -> Column:
            content = F.zip_with(lines, kinds, lambda l, k: F.when(k == "O", rstrip_ws(l)).otherwise(l))
            return _assemble(F.zip_with(content, kinds, _token))

        return let(_line_kinds(lines), with_kinds)

    return let(F.split(text, "\n", -1), with_lines)


def _compact_plain(text: Column) -> Column:
    """Fence-free text: five whole-string regex passes, no arrays."""
    t = F.regexp_replace(text, f"(?md)(?<!{WS_NO_NL}){WS_NO_NL}++$", "")  # right-strip every line
    t = F.regexp_replace(t, f"(?md)^{WS_NO_NL}*\\|{WS_NO_NL[:-1]}|]*\\|(?:\n|\\z)", "")  # drop empty table rows
    t = F.regexp_replace(t, "^\n+", "")  # leading blank lines
    t = F.regexp_replace(t, "(?<!\n)\n++\\z", "")  # trailing blank lines, each run read once
    return F.regexp_replace(t, "\n{3,}", "\n\n")  # a run of blank lines -> one


def compact_markdown(col: Column) -> Column:
    """Compacted Markdown; NULL stays NULL and '' stays ''."""
    return let(
        normalize_markdown(col),
        lambda t: F.when(t.rlike(ANY_FENCE_RX), _compact_fenced(t)).otherwise(_compact_plain(t)),
    )


def maybe_compact(col: Column, enabled: Column | bool = True) -> Column:
    """Compact only when the per-row (or plan-time) flag is true."""
    if isinstance(enabled, bool):
        return compact_markdown(col) if enabled else col
    return F.when(enabled, compact_markdown(col)).otherwise(col)
