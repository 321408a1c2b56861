"""HTML -> Markdown (X4) in a fixed number of linear passes.

Not a general HTML parser: it covers the tags documents and scraped pages
use. Script, style, head and comments go first (a ``</p>`` inside a script
string must not end a paragraph). The text is then cut at ``<pre>`` and ``</pre>``: the
parts between them become fenced code with their white space kept, the others are
rewritten: links, images, ordered lists, headings, emphasis, list items, table
rows and block breaks; every other tag is dropped and entities are unescaped with
``&amp;`` last. Tag names match whole (``<link>`` is no list item, ``<header>`` no
head); a table row becomes ``| cell | cell |``.

Linear in the text whatever it holds: a tag never reaches over the next ``<`` or ``>``, so an
unclosed one is read once. What belongs together over a distance (a link and its text, a list and its items) is not searched
from every opening tag: the text is cut at the closing tags, and each piece is looked at once.

Patterns are written once for Java and RE2; where they must differ (RE2 is linear without help) both are given.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from docprep.functions.text import let, strip_ws

# Names of the entities of Western European letters and punctuation that are unescaped.
_LETTERS = [v + mark for mark in ("acute", "grave", "circ", "uml") for v in "aeiouAEIOU"]
_OTHERS = "ntilde Ntilde ccedil Ccedil iquest iexcl laquo raquo lsquo rsquo ldquo rdquo ndash mdash hellip euro copy reg ordm ordf deg".split()

Rule = tuple[str, str, str]  # Java pattern, RE2 pattern, replacement with $n groups


def _same(pattern: str, replacement: str) -> Rule:
    return pattern, pattern, replacement


def _block(name: str) -> Rule:
    """Drop an element with its content; an unclosed one takes the rest of the text, which stays."""
    opening = f"<{name}(?:\\s[^<>]*)?>"
    whole = f"(?is){opening}.*?</{name}>"
    return f"{whole}|({opening}.*+)", whole, "$1"


# Whole text, before it is cut at <pre>.
RAW_RULES: list[Rule] = [
    _block("script"),
    _block("style"),
    _block("head"),
    ("(?s)<!--.*?-->|(<!--.*+)", "(?s)<!--.*?-->", "$1"),
    _same("(?i)<!doctype[^<>]*>", ""),
]
PRE_TAG = "(?i)</?pre(?:\\s[^<>]*)?>"
LINK_END = "(?i)</a\\s*>"
# the last link that begins in the text before a closing tag
LINK = "(?is)^(.*)<a\\s[^<>]*?href=(?:\"([^\"<>]*)\"|'([^'<>]*)')[^<>]*>(.*)$"
IMAGE = "(?i)<img\\s"
IMAGE_REST = "^[^<>]*>"
ALT, SRC = "(?is)(?:^|\\s)alt=\"([^\"<>]*)\"", "(?is)(?:^|\\s)src=\"([^\"<>]*)\""
LIST, LIST_END, ITEM = "(?i)<ol(?:\\s[^<>]*)?>", "(?i)</ol\\s*>", "(?i)<li(?:\\s[^<>]*)?>"
ANY_TAG = "<[^<>]*>"

# Each part outside <pre>, after links, images and ordered lists. Order matters.
RULES: list[Rule] = [
    *[_same(f"(?i)<h{n}(?:\\s[^<>]*)?>", "\n\n" + "#" * n + " ") for n in range(1, 7)],
    _same("(?i)</?(?:b|strong)(?:\\s[^<>]*)?>", "**"),
    _same("(?i)</?(?:i|em)(?:\\s[^<>]*)?>", "*"),
    _same(ITEM, "\n* "),
    _same("(?i)<tr(?:\\s[^<>]*)?>", "\n|"),
    _same("(?i)<t[dh](?:\\s[^<>]*)?>", " "),
    _same("(?i)</t[dh]\\s*>", " |"),
    _same("(?i)<br[^<>]*>", "\n"),
    _same("(?i)</?(?:p|div|article|section|ul|nav|header|footer|main|aside|table|blockquote|h[1-6])(?:\\s[^<>]*)?>", "\n\n"),
    _same(ANY_TAG, ""),
]
ENTITIES: list[tuple[str, str]] = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    *[(f"&{name};", chr(name2codepoint[name])) for name in (*_LETTERS, *_OTHERS)],
    ("&amp;", "&"),
]
SPACE_RULES: list[Rule] = [
    ("(?<![ \\t])[ \\t]++\n", "[ \\t]+\n", "\n"),
    _same("\n[ \\t]+", "\n"),
    _same("\n{3,}", "\n\n"),
]


def re2_replacement(rep: str) -> str:
    return re.sub(r"\$(\d)", r"\\\1", rep)


def _rewritten(col: Column, rules: list[Rule]) -> Column:
    for java, _, rep in rules:
        col = F.regexp_replace(col, java, rep)
    return col


def _unescaped(col: Column) -> Column:
    """Entities; texts without an ampersand skip all of the replacements."""

    def replaced(t: Column) -> Column:
        out = t
        for name, char in ENTITIES:
            out = F.replace(out, F.lit(name), F.lit(char))
        return F.when(F.contains(t, F.lit("&")), out).otherwise(t)

    return let(col, replaced)


def _links(col: Column) -> Column:
    """``[text](href)`` for the last link opened before each closing tag."""

    def linked(parts: Column) -> Column:
        n = F.size(parts)
        return F.array_join(F.transform(parts, lambda p, i: F.when(i < n - 1, F.regexp_replace(p, LINK, "$1[$4]($2$3)")).otherwise(p)), "")

    return let(F.split(col, LINK_END, -1), linked)


def _images(col: Column) -> Column:
    def shown(p: Column) -> Column:
        tag = F.regexp_extract(p, IMAGE_REST, 0)
        src = F.regexp_extract(tag, SRC, 1)
        image = F.concat(F.lit("!["), F.regexp_extract(tag, ALT, 1), F.lit("]("), src, F.lit(")"))
        return F.concat(F.when(src != "", image).otherwise(""), F.regexp_replace(p, IMAGE_REST, ""))

    return F.array_join(F.transform(F.split(col, IMAGE, -1), lambda p, i: F.when(i == 0, p).otherwise(shown(p))), "")


def _ordered_lists(col: Column) -> Column:
    """Items of ``<ol>`` numbered from 1; lists do not nest: the next ``</ol>`` ends one."""

    def numbered(body: Column) -> Column:
        lines = F.transform(F.split(body, ITEM, -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("\n"), i.cast("string"), F.lit(". "), x)))
        return F.array_join(lines, "")

    def ended(x: Column) -> Column:
        return let(
            F.split(x, LIST_END, -1),
            lambda y: F.concat(F.lit("\n\n"), numbered(y[0]), F.lit("\n\n"), F.array_join(F.slice(y, F.lit(2), F.size(y)), "\n\n")),
        )

    return F.array_join(F.transform(F.split(col, LIST, -1), lambda x, i: F.when(i == 0, x).otherwise(ended(x))), "")


def _outside(part: Column) -> Column:
    text = _rewritten(_ordered_lists(_images(_links(part))), RULES)
    return strip_ws(_rewritten(_unescaped(text), SPACE_RULES))


def _code(part: Column) -> Column:
    """Text between <pre> tags as fenced code: tags go, white space stays."""
    body = F.regexp_replace(_unescaped(F.regexp_replace(part, ANY_TAG, "")), "^\n|(?<!\n)\n++\\z", "")
    return F.when(F.trim(body) != "", F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise("")


def html_to_markdown(html: Column | str) -> Column:
    """Markdown text of an HTML document (NULL stays NULL)."""
    col = F.col(html) if isinstance(html, str) else html
    parts = F.split(_rewritten(col, RAW_RULES), PRE_TAG, -1)
    shown = F.transform(parts, lambda p, i: F.when(i % 2 == 1, _code(p)).otherwise(_outside(p)))
    return F.array_join(F.filter(shown, lambda x: x != ""), "\n\n")
