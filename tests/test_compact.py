"""Compaction (C1-C8): literal cases and properties of random texts."""

import random
import re

from conftest import one

from pyspark.sql import functions as F

from docprep.functions.compact import compact_markdown, maybe_compact


# (text, compacted) by the rules C1-C8
CASES = [
    ("uno\r\ndos\rtres", "uno\ndos\ntres"),  # C1
    ("in\u200bvi\ufeffsi\u00adble", "invisible"),  # C2
    ("5\u00a0km", "5 km"),
    ("pre <!-- fuera --> post", "pre  post"),  # C3: both blanks stay
    ("k\n<!-- uno\ndos\n\ntres -->\nl", "k\n\nl"),
    ("antes <!-- abierta\n\n\nfin <!-- otra", "antes <!-- abierta\n\nfin <!-- otra"),
    ("~~~\n  z  \n\n\n~~~\nfuera  ", "~~~\n  z  \n\n\n~~~\nfuera"),  # C4
    ("q\n\t```py  \n\n\n~~~\n\n\nr", "q\n\t```py  \n\n\n~~~\n\nr"),  # either marker closes either
    ("s\n   ```\n \n\n\n", "s\n   ```\n \n\n\n"),  # an open fence protects the rest
    ("t\n```\n<!-- va -->x\n```", "t\n```\nx\n```"),  # comments go in code too
    ("fin de linea \t \notra\u3000", "fin de linea\notra"),  # C5
    ("\n \n\t\nabc\n\n\n\n\ndef\n \n", "abc\n\ndef"),  # C6
    ("|p|q|\n| |  |\n|r|s|", "|p|q|\n|r|s|"),  # C7
    ("|h|\n|:--|\n||\n|v|", "|h|\n|:--|\n|v|"),
    ("w\n\n| |\n\nx", "w\n\nx"),  # a dropped row does not end a blank run
    ("igual\nigual\nigual", "igual\nigual\nigual"),  # C8
    ("|7|7|\n|7|7|", "|7|7|\n|7|7|"),
    ("", ""),
]


def test_literal_cases(spark):
    got = one(spark, compact_markdown, *[c for c, _ in CASES])
    assert got == [e for _, e in CASES]


def test_null_stays_null(spark):
    assert one(spark, compact_markdown, None) == [None]


def test_flag_off_keeps_the_text(spark):
    text = "uno  \n\n\n\ndos"
    off = one(spark, lambda c: maybe_compact(c, False), text)[0]
    per_row = one(spark, lambda c: maybe_compact(c, F.length(c) > 10), text, "x \n")
    assert off == text and per_row == ["uno\n\ndos", "x \n"]


def _random_texts(n, pieces, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_fuzz_properties_without_fences(spark):
    pieces = ["a", "b", " ", "\t", "\n", "\n", "\n", "|", "<!--", "-->", "\r", "\u00a0", "\u200b", "x y", "\u3000"]
    texts = _random_texts(2000, pieces, 11)
    got = one(spark, compact_markdown, *texts)
    assert one(spark, compact_markdown, *got) == got or any("<!--" in g for g in got)
    for t, g in zip(texts, got):
        lines = g.split("\n")
        assert "\r" not in g and "\u00a0" not in g and "\u200b" not in g
        assert "\n\n\n" not in g and (not g or (lines[0] and lines[-1]))
        assert all(x == x.rstrip() for x in lines)
        assert not any(re.fullmatch(r"[\s|]*\|[\s|]*\|[\s|]*", x) for x in lines)
        visible = re.sub(r"(?s)<!--.*?-->", "", t)
        assert sorted(g.replace("|", "").split()) == sorted(visible.replace("\u200b", "").replace("|", "").split())


def test_fenced_lines_stay_byte_for_byte(spark):
    body = _random_texts(500, ["a", " ", "\t", "\n", "|", "x y"], 5)
    got = one(spark, compact_markdown, *[f"p\n```\n{t}\n```\nq" for t in body])
    assert got == [f"p\n```\n{t}\n```\nq" for t in body]


def test_sample_document(spark):
    sample = "# Título\u00a0\n\n\n\nTexto   \n<!-- c -->\n| | |\n```\n  code  \n\n\n```\nfin\n\n"
    assert one(spark, compact_markdown, sample)[0] == "# Título\n\nTexto\n\n```\n  code  \n\n\n```\nfin"


def test_long_runs_neither_overflow_nor_blow_up(spark):
    n = 60_000
    texts = ["\n" * n + "```\nx\n```", "|" * n, "| " * n + "\nz", "a" + " " * n + "b"]
    got = one(spark, compact_markdown, *texts)
    assert got == ["```\nx\n```", "", "z", texts[3]]


def _seconds(spark, fn, text):
    import time

    df = spark.createDataFrame([(text,)], "v string").select(fn(F.col("v")).alias("o"))
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - start


def test_interior_blank_runs_take_linear_time(spark):
    n = 400_000
    prose = "palabra " * (n // 8)
    _seconds(spark, compact_markdown, prose)  # compiled once
    for text in ("a" + "\n" * n + "b", "a\n```\nx\n```" + "\n" * n + "b", "a " + "<!-- " * (n // 5)):
        assert _seconds(spark, compact_markdown, text) < 10 * _seconds(spark, compact_markdown, prose) + 5
    got = one(spark, compact_markdown, "a" + "\n" * n + "b", "a\n```\nx\n```" + "\n" * n + "b")
    assert got == ["a\n\nb", "a\n```\nx\n```\n\nb"]
